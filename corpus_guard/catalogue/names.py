"""Word lists and lookup tables."""

# These must equal the scanner being matched for its results to be reproduced.

SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}

EXTENSION_LANGUAGE = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
}

STANDALONE_EXTENSION_LANGUAGE = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "typescript",
    ".jsx": "typescript",
}

SUPPORTED_LANGUAGES = ("python", "typescript", "javascript")

MAX_FILE_SIZE_BYTES = 1_000_000

DEFAULT_IGNORE_PATTERNS = (
    "__pycache__/",
    "*.pyc",
    "*.pyo",
    ".git/",
    ".hg/",
    ".svn/",
    "node_modules/",
    ".venv/",
    "venv/",
    "env/",
    ".env/",
    "dist/",
    "build/",
    "*.egg-info/",
    ".tox/",
    ".mypy_cache/",
    ".ruff_cache/",
    ".pytest_cache/",
    "*.min.js",
    "*.bundle.js",
    "package-lock.json",
    "yarn.lock",
    "poetry.lock",
    "*.lock",
)

STANDALONE_IGNORE_DIRS = (
    "__pycache__",
    "node_modules",
    ".venv",
    "venv",
    "env",
    ".git",
    "dist",
    "build",
    "*.egg-info",
    ".tox",
)

STANDALONE_COUNT_SKIP_DIRS = (
    "__pycache__",
    "node_modules",
    ".venv",
    "venv",
    "env",
    ".git",
    "dist",
    "build",
)

DANGEROUS_TOOLS = (
    "ShellTool",
    "PythonREPLTool",
    "BashTool",
    "FileManagementToolkit",
    "WriteFileTool",
    "CopyFileTool",
    "DeleteFileTool",
    "MoveFileTool",
    "SqlDatabaseToolkit",
    "SQLDatabaseTool",
    "RequestsGetTool",
    "RequestsPostTool",
    "GmailSendMessage",
    "SlackSendMessage",
    "GmailCreateDraft",
    "E2BDataAnalysisTool",
    "HumanInputRun",
)

# Looked up case-sensitively; any other tool is medium.
TOOL_SEVERITY = {
    "ShellTool": "critical",
    "BashTool": "critical",
    "PythonREPLTool": "critical",
    "PythonAstREPLTool": "critical",
    "WriteFileTool": "high",
    "DeleteFileTool": "high",
    "MoveFileTool": "high",
    "GmailSendMessage": "high",
    "SlackSendMessage": "high",
    "SqlDatabaseToolkit": "high",
}

TAINTED_NAMES = (
    "user_input",
    "user_message",
    "user_query",
    "user_request",
    "user_text",
    "message",
    "query",
    "request",
    "input_text",
    "user_data",
    "human_input",
    "human_message",
)

PROMPT_NAMES = (
    "prompt",
    "system_prompt",
    "messages",
    "chat_history",
    "full_prompt",
    "template",
    "instruction",
)

TEST_PATH_WORDS = ("test", "spec", "fixture", "mock", "example")

# Regular expressions, in Python syntax, matched ignoring case.
PII_PLACEHOLDER = r"^0+$|^1{3}[.\-]?2{3}[.\-]?3{3}|xxx|000|999|123|example|test|fake|dummy"
SECRET_PLACEHOLDER = (
    r"xxx|your[_\-]?(?:api[_\-]?key|key)|example|replace|placeholder|<|dummy|fake|test"
)

CATEGORY_LABELS = {
    "prompt_injection": "Prompt Injection",
    "insecure_output": "Insecure Output Handling",
    "data_leak": "Data Leak / PII",
    "excessive_agency": "Excessive Agency",
    "secret_exposure": "Secret Exposure",
    "rag_security": "RAG Security",
    "jailbreak": "Jailbreak Pattern",
}

JUDGE_PROMPT = """You are a security expert reviewing potential LLM application vulnerabilities.

For each finding below, analyze the code snippet and determine if it's a TRUE POSITIVE
(genuine security vulnerability) or FALSE POSITIVE (not actually vulnerable).

Be conservative: when uncertain, mark as true positive.

Finding:
- Rule: {rule_id}
- Title: {title}
- Severity: {severity}
- Code:
{code_snippet}

Description: {description}

Respond with ONLY valid JSON in this exact format:
{"verdict": "true_positive" | "false_positive", "confidence": 0.0-1.0, "reasoning": "brief explanation"}"""
EMPTY_SNIPPET = "(no code snippet available)"
