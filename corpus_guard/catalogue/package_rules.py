"""The built-in rule set (the seven detectors, in detector order).

The tables below are fixed values: identifiers, regular expressions (Python syntax, matched
ignoring case), severities, confidences and message texts that findings must reproduce. The
``needs`` strings next to a pattern are this engine's prefilter and not part of the rule.
"""

from __future__ import annotations

import re

from corpus_guard.catalogue import fix_texts
from corpus_guard.catalogue.model import Rule
from corpus_guard.catalogue.names import DANGEROUS_TOOLS

# A unit-level requirement that is a pattern instead of a string: three digits in a row.
THREE_DIGITS = r"\d{3}"

PYTHON = ("python",)
SCRIPT = ("typescript", "javascript")
_QUOTE = ('"', "'")

# ---------------------------------------------------------------- fixed values: OWASP entries
_SITE = "https://owasp.org/www-project-top-10-for-large-language-model-applications/"
_LLM01 = ("LLM01", "Prompt Injection", _SITE + "llm01-prompt-injection")
_LLM02 = ("LLM02", "Insecure Output Handling", _SITE + "llm02-insecure-output-handling")
_LLM06 = (
    "LLM06",
    "Sensitive Information Disclosure",
    _SITE + "llm06-sensitive-information-disclosure",
)
_LLM06_RETRIEVAL = ("LLM06", "Sensitive Information Disclosure (RAG)", _SITE)
_LLM08 = ("LLM08", "Excessive Agency", _SITE + "llm08-excessive-agency")
_LLM01_JAILBREAK = ("LLM01", "Prompt Injection / Jailbreak", _SITE)

# ---------------------------------------------------------------- fixed values: prompt injection
_PROMPT_PYTHON = [
    (
        r'f["\'].*\{(?:user_input|user_message|user_query|user_request|user_text|'
        r'message|query|request|input|prompt|text|data|content|user_data)\}.*["\']',
        (("{",), ('f"', "f'")),
    ),
    (
        r'["\'].*\{(?:user_input|user_message|query|request|input|prompt)\}.*["\']\.format\(',
        (("{",), (".format(",)),
    ),
    (r'["\'].*%s.*["\'] ?%', (("%",), ("%s",))),
    (
        r"(?:prompt|system_prompt|messages)\s*[+]=?\s*(?:user_input|user_message|request|query)",
        (("prompt+", "messages+"),),
    ),
    (
        r"(?:user_input|user_message|request|query)\s*\+\s*(?:prompt|system_prompt)",
        (("user_input+", "user_message+", "request+", "query+"),),
    ),
    (
        r'PromptTemplate\.from_template\(["\'].*\{(?:user_input|input|query|request)\}',
        (("{",), ("prompttemplate.from_template(",)),
    ),
    (
        r'llm\.(?:invoke|predict|call|generate|complete)\(f["\']',
        (("llm.invoke(", "llm.predict(", "llm.call(", "llm.generate(", "llm.complete("),),
    ),
    (
        r"(?:ChatOpenAI|ChatAnthropic|ChatGroq|AzureChatOpenAI)\([^)]*\)\s*\.\s*"
        r'(?:invoke|predict)\s*\(\s*f["\']',
        (("chatopenai(", "chatanthropic(", "chatgroq("),),
    ),
    (r'HumanMessage\(content=f["\']', (("humanmessage(",),)),
    (
        r"SystemMessage\(content=(?:user_input|user_message|request)",
        (("systemmessage(",),),
    ),
]

_PROMPT_SCRIPT = [
    (
        r"`(?:[^`]*)\$\{(?:userInput|userMessage|request\.body|req\.body|input|query|message)\}"
        r"(?:[^`]*)`",
        (("`",), ("${",)),
    ),
    (
        r"(?:prompt|systemPrompt|messages)\s*[+]=?\s*"
        r"(?:userInput|userMessage|req\.body|request\.body)",
        (("prompt+", "messages+"),),
    ),
    (
        r"openai\.(?:chat\.completions\.create|createChatCompletion)\([^)]*`[^`]*\$\{",
        (("`",), ("${",), ("openai.",)),
    ),
    (
        r"anthropic\.messages\.create\([^)]*`[^`]*\$\{(?:userInput|input|message)",
        (("`",), ("${",), ("anthropic.messages",)),
    ),
]


def _prompt_injection() -> list[Rule]:
    python = dict(
        rule_id="LLM01-001",
        title="Prompt Injection via Unsanitized User Input",
        severity="critical",
        category="prompt_injection",
        description=(
            "User input is directly interpolated into the LLM prompt without sanitization. An "
            "attacker can craft malicious input to override system instructions, extract "
            "sensitive data, or manipulate the model's behavior (Prompt Injection — OWASP LLM01)."
        ),
        description_pt=(
            "A entrada do usuário é inserida diretamente no prompt do LLM sem sanitização. Um "
            "atacante pode craftar uma entrada maliciosa para sobrescrever instruções do sistema, "
            "extrair dados sensíveis ou manipular o comportamento do modelo (Prompt Injection — "
            "OWASP LLM01)."
        ),
        recommendation=(
            "Use structured prompt templates with variables (LangChain PromptTemplate). Validate "
            "and sanitize all user input. Implement input length limits and content filtering. "
            "Consider using a dedicated prompt injection detection library."
        ),
        recommendation_pt=(
            "Use templates de prompt estruturados com variáveis (LangChain PromptTemplate). "
            "Valide e sanitize todas as entradas do usuário. Implemente limites de tamanho e "
            "filtragem de conteúdo. Considere usar uma biblioteca de detecção de prompt injection."
        ),
        fix_example=fix_texts.PROMPT_PYTHON,
        confidence=0.85,
        references=(
            _SITE,
            "https://learnprompting.org/docs/prompt_hacking/injection",
            "https://python.langchain.com/docs/concepts/prompt_templates/",
        ),
        tags=("prompt-injection", "llm01", "user-input", "python"),
    )
    concat = dict(
        rule_id="LLM01-002",
        title="Prompt Injection via String Concatenation (AST)",
        severity="critical",
        category="prompt_injection",
        description=(
            "AST analysis detected string concatenation of a user-controlled variable with a "
            "prompt variable. This pattern enables prompt injection attacks."
        ),
        description_pt=(
            "A análise AST detectou concatenação de string de uma variável controlada pelo "
            "usuário com uma variável de prompt. Este padrão permite ataques de prompt injection."
        ),
        recommendation=(
            "Replace string concatenation with structured prompt templates. Pass user input as a "
            "separate variable, never concatenate it into the prompt."
        ),
        fix_example=fix_texts.PROMPT_PYTHON,
        confidence=0.90,
        references=(_SITE,),
        tags=("prompt-injection", "llm01", "ast", "string-concat"),
        detected_by="ast",
    )
    script = dict(
        rule_id="LLM01-003",
        title="Prompt Injection via Template Literal (TypeScript)",
        severity="critical",
        category="prompt_injection",
        description=(
            "User input is interpolated via template literals into an LLM API call. This enables "
            "prompt injection attacks."
        ),
        description_pt=(
            "A entrada do usuário é interpolada via template literals em uma chamada de API LLM. "
            "Isso permite ataques de prompt injection."
        ),
        recommendation=(
            "Use structured message arrays for OpenAI/Anthropic APIs. Pass user input as the "
            "'content' of a HumanMessage object, not embedded in the system prompt template."
        ),
        fix_example=fix_texts.PROMPT_TYPESCRIPT,
        confidence=0.85,
        references=(_SITE,),
        tags=("prompt-injection", "llm01", "typescript", "template-literal"),
    )
    owasp = _owasp(_LLM01)
    rules = [
        Rule(
            pattern=p,
            needs=n,
            languages=PYTHON,
            context="hash",
            **(per_call(p) or per_line(p)),
            **python,
            **owasp,
        )
        for p, n in _PROMPT_PYTHON
    ]
    rules.append(Rule(pattern="", kind="concat", languages=PYTHON, **concat, **owasp))
    rules += [
        Rule(
            pattern=p, needs=n, languages=SCRIPT, context="slash", **per_call(p), **script, **owasp
        )
        for p, n in _PROMPT_SCRIPT
    ]
    return rules


# ---------------------------------------------------------------- fixed values: data leak
_PII = [
    (
        "LLM06-CPF-001",
        r"\b\d{3}[.\-]?\d{3}[.\-]?\d{3}[.\-]?\d{2}\b",
        "Brazilian CPF number detected in source code or prompt template",
        "high",
        ((THREE_DIGITS,),),
    ),
    (
        "LLM06-CNPJ-001",
        r"\b\d{2}[.\-]?\d{3}[.\-]?\d{3}[/]?\d{4}[.\-]?\d{2}\b",
        "Brazilian CNPJ number detected in source code or prompt template",
        "high",
        ((THREE_DIGITS,),),
    ),
    (
        "LLM06-SSN-001",
        r"\b\d{3}[-]\d{2}[-]\d{4}\b",
        "US Social Security Number (SSN) pattern detected",
        "high",
        ((THREE_DIGITS,),),
    ),
    (
        "LLM06-CC-001",
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|"
        r"6(?:011|5[0-9]{2})[0-9]{12})\b",
        "Credit card number pattern detected in source code",
        "critical",
        ((THREE_DIGITS,),),
    ),
    (
        "LLM06-EMAIL-001",
        r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
        "Email address hardcoded in prompt template or source",
        "medium",
        (("@",),),
    ),
]

_PII_VARIABLES = [
    (
        r"(?:cpf|cnpj|ssn|social_security|credit_card|card_number|passwd|password|senha)"
        r"\s*[=:]\s*\S+",
        (
            tuple(
                name + sign
                for name in ("cpf", "cnpj", "ssn", "social_security", "credit_card")
                + ("card_number", "passwd", "password", "senha")
                for sign in "=:"
            ),
        ),
    ),
    (
        r"(?:cpf|cnpj|ssn|cc_number|card_num).*(?:llm|openai|anthropic|groq|llm\.invoke)",
        (("cpf", "cnpj", "ssn", "cc_number", "card"),),
    ),
    (
        r"(?:prompt|context|messages).*(?:cpf|cnpj|ssn|credit_card|senha|password)",
        (("cpf", "cnpj", "ssn", "card", "senha", "password"),),
    ),
    (
        r"(?:log|logger|logging|print)\s*\(.*(?:user_input|query|message|prompt)",
        (("log(", "logger(", "logging(", "print("),),
    ),
    (
        r"(?:log\.info|log\.debug|logger\.info|logger\.debug|print)\s*\(.*"
        r"(?:user_data|pii|personal)",
        (("log.info(", "log.debug(", "logger.info(", "logger.debug(", "print("),),
    ),
]

_SECRETS_IN_PROMPTS = [
    (
        r'(?:system_prompt|system_message|prompt|SYSTEM)\s*=\s*["\'].*'
        r"(?:sk-|api[_-]?key|secret|token|password)",
        (("prompt=", "system_message=", "system="), _QUOTE),
    ),
    (
        r'f["\'].*(?:password|secret|api_key|token|sk-|bearer)\s*[=:]\s*\{',
        (("{",), ('f"', "f'")),
    ),
]

_LOGGING = [
    (
        r"(?:logger|logging|log)\.\w+\s*\(.*(?:prompt|response|llm_response|completion|output)",
        (("(",), ("log",)),
    ),
    (
        r"print\s*\(.*(?:full_prompt|system_prompt|user_data|pii)",
        (("print(",),),
    ),
    (
        r"(?:console\.log|winston|logger)\s*\(.*(?:prompt|response|userInput)",
        (("console.log(", "winston(", "logger("),),
    ),
]


def _data_leak() -> list[Rule]:
    common = dict(category="data_leak", context="any", **_owasp(_LLM06))
    rules = [
        Rule(
            rule_id=rule_id,
            title="PII Pattern Detected: " + _first_words(what, 2),
            severity=severity,
            pattern=pattern,
            needs=needs,
            engine_pattern=bounded(pattern),
            value_filter="pii",
            description=what
            + ". Hardcoded PII in source code may be sent to external LLM APIs and logged, "
            "violating LGPD/GDPR data protection requirements.",
            description_pt=f"Padrão de PII detectado: {what}. Dados pessoais hardcoded no código "
            "podem ser enviados para APIs de LLM externas e registrados em logs, violando a LGPD.",
            recommendation=(
                "Remove all hardcoded PII from source code. Use environment variables or a "
                "secrets manager. Implement data masking before sending to LLM APIs. Review "
                "LGPD/GDPR compliance for your LLM use case."
            ),
            recommendation_pt=(
                "Remova todos os dados pessoais do código-fonte. Use variáveis de ambiente ou um "
                "gerenciador de segredos. Implemente mascaramento de dados antes de enviar para "
                "APIs de LLM. Revise conformidade com a LGPD."
            ),
            fix_example=fix_texts.PII,
            confidence=0.75,
            tags=("pii", "data-leak", "lgpd", "gdpr", "llm06"),
            **common,
        )
        for rule_id, pattern, what, severity, needs in _PII
    ]
    rules += [
        Rule(
            rule_id="LLM06-PII-VAR-001",
            title="PII Variable Potentially Sent to LLM API",
            severity="high",
            pattern=pattern,
            needs=needs,
            **per_line(pattern),
            description=(
                "A variable name suggesting PII (CPF, CNPJ, SSN, password, credit card) appears "
                "to be used in or near an LLM API call. This may cause sensitive data to be sent "
                "to external AI services."
            ),
            description_pt=(
                "Um nome de variável sugerindo PII (CPF, CNPJ, SSN, senha, cartão de crédito) "
                "parece ser usado próximo a uma chamada de API LLM. Isso pode causar o envio de "
                "dados sensíveis para serviços de IA externos."
            ),
            recommendation=(
                "Audit all data sent to LLM APIs. Implement data classification and mask or "
                "pseudonymize PII before including in prompts. Consider using a local/private LLM "
                "for sensitive data processing."
            ),
            fix_example=fix_texts.PII_MASKING,
            confidence=0.70,
            tags=("pii", "data-leak", "lgpd", "llm06", "api-call"),
            **common,
        )
        for pattern, needs in _PII_VARIABLES
    ]
    rules += [
        Rule(
            rule_id="LLM06-SECRET-PROMPT-001",
            title="Secret/Credential Embedded in Prompt Template",
            severity="critical",
            pattern=pattern,
            needs=needs,
            **per_line(pattern),
            description=(
                "An API key, password, or secret token appears to be embedded in a prompt "
                "template. This can expose credentials to end users via prompt extraction attacks "
                "or log exposure."
            ),
            description_pt=(
                "Uma chave de API, senha ou token secreto parece estar embutido em um template de "
                "prompt. Isso pode expor credenciais para usuários finais via ataques de extração "
                "de prompt ou exposição de logs."
            ),
            recommendation=(
                "Never embed secrets in prompt templates. Use environment variables and pass "
                "configuration separately from the prompt. Rotate any exposed credentials "
                "immediately."
            ),
            fix_example=fix_texts.SECRET_PROMPT,
            confidence=0.85,
            tags=("secret-exposure", "prompt", "credentials", "llm06"),
            **common,
        )
        for pattern, needs in _SECRETS_IN_PROMPTS
    ]
    rules += [
        Rule(
            rule_id="LLM06-LOG-001",
            title="Logging of LLM Prompt/Response May Expose Sensitive Data",
            severity="medium",
            pattern=pattern,
            needs=needs,
            **per_line(pattern),
            description=(
                "LLM prompts or responses are being logged. If these contain user PII or "
                "sensitive data, it will be persisted in log files which may not have adequate "
                "access controls."
            ),
            description_pt=(
                "Prompts ou respostas do LLM estão sendo registrados em logs. Se contiverem PII "
                "de usuários ou dados sensíveis, serão persistidos em arquivos de log que podem "
                "não ter controles de acesso adequados."
            ),
            recommendation=(
                "Implement structured logging with PII scrubbing. Log only metadata (tokens used, "
                "latency, model) not the actual content. If content logging is required, "
                "implement data masking first."
            ),
            fix_example=fix_texts.LOGGING,
            confidence=0.65,
            tags=("logging", "pii", "data-leak", "llm06"),
            **common,
        )
        for pattern, needs in _LOGGING
    ]
    return rules


# ---------------------------------------------------------------- fixed values: insecure output
_OUTPUT = (
    r"(?:llm_response|ai_response|aiResponse|llmResponse|modelResponse|model_response|completion|"
    r"response|output|generated|result|answer|generated_text|llm_output|ai_output|bot_response|"
    r"chat_response|gpt_response|claude_response)"
)

_OS_CALL = r"(?:os\.system|subprocess\.(?:run|call|check_output|Popen)|os\.popen)\s*\(\s*"

_OUTPUT_PYTHON = [
    (
        "LLM02-XSS-001",
        r"(?:render_template_string|Markup|mark_safe|format_html)\s*\(\s*" + _OUTPUT,
        "LLM output rendered as raw HTML (XSS risk)",
        "critical",
        (("render_template_string(", "markup(", "mark_safe(", "format_html("),),
    ),
    (
        "LLM02-EVAL-001",
        r"(?:eval|exec|compile)\s*\(\s*" + _OUTPUT,
        "LLM output passed to eval/exec (Remote Code Execution risk)",
        "critical",
        (("eval(", "exec(", "compile("),),
    ),
    (
        "LLM02-SQL-001",
        r"(?:cursor\.execute|db\.execute|engine\.execute|session\.execute)\s*\(.*?" + _OUTPUT,
        "LLM output interpolated into SQL query (SQL Injection via LLM)",
        "critical",
        ((".execute(",),),
    ),
    (
        "LLM02-OS-001",
        _OS_CALL + r"(?:f[\"'].*"
        + _OUTPUT
        + "|"
        + _OUTPUT
        + ")",
        "LLM output used in OS/shell command (Command Injection risk)",
        "critical",
        (
            ("os.system(", "os.popen(", "subprocess.run(", "subprocess.call(")
            + ("subprocess.check_output(", "subprocess.popen("),
        ),
    ),
    (
        "LLM02-SSRF-001",
        r"(?:requests\.(?:get|post|put)|httpx\.(?:get|post)|urllib\.request\.urlopen)\s*\(\s*"
        + _OUTPUT,
        "LLM output used as URL in HTTP request (SSRF risk)",
        "high",
        (
            ("requests.get(", "requests.post(", "requests.put(", "httpx.get(", "httpx.post(")
            + ("urllib.request.urlopen(",),
        ),
    ),
    (
        "LLM02-TEMPLATE-001",
        r"(?:jinja2\.Template|Template)\s*\(\s*" + _OUTPUT + r"\s*\)\.render",
        "LLM output used as Jinja2 template (Server-Side Template Injection risk)",
        "critical",
        (("template(",),),
    ),
    (
        "LLM02-FILE-001",
        r"(?:open|write_text|write_bytes)\s*\(\s*" + _OUTPUT,
        "LLM output written directly to file without validation",
        "medium",
        (("open(", "write_text(", "write_bytes("),),
    ),
    (
        "LLM02-PICKLE-001",
        r"(?:pickle\.loads|pickle\.load|dill\.loads)\s*\(\s*" + _OUTPUT,
        "LLM output deserialized with pickle (arbitrary code execution risk)",
        "critical",
        (("pickle.loads(", "pickle.load(", "dill.loads("),),
    ),
]

_OUTPUT_SCRIPT = [
    (
        "LLM02-XSS-TS-001",
        r"(?:innerHTML|outerHTML|document\.write|dangerouslySetInnerHTML)\s*[=:]\s*"
        r"(?:\{?\s*__html\s*:\s*)?" + _OUTPUT,
        "LLM output set as innerHTML/dangerouslySetInnerHTML (XSS risk)",
        "critical",
        (
            tuple(
                name + sign
                for name in ("innerhtml", "outerhtml", "document.write")
                for sign in "=:"
            ),
        ),
    ),
    (
        "LLM02-EVAL-TS-001",
        r"(?:eval|new Function|setTimeout|setInterval)\s*\(\s*" + _OUTPUT,
        "LLM output passed to eval/Function constructor (Code Execution risk)",
        "critical",
        (("eval(", "function(", "settimeout(", "setinterval("),),
    ),
    (
        "LLM02-SQL-TS-001",
        r"(?:db\.query|pool\.query|client\.query|connection\.query)\s*\(\s*[`\"\'].*\$\{" + _OUTPUT,
        "LLM output interpolated into SQL query (SQL Injection via LLM)",
        "critical",
        (("${",), (".query(",)),
    ),
]

# The first key contained in a rule id picks its tag, recommendation and fix example.
_OUTPUT_TAGS = {
    "XSS": "xss",
    "EVAL": "code-execution",
    "SQL": "sql-injection",
    "OS": "command-injection",
    "SSRF": "ssrf",
    "TEMPLATE": "ssti",
    "FILE": "file-write",
    "PICKLE": "deserialization",
}
_OUTPUT_RECOMMENDATION = {
    "XSS": "Use a proper HTML templating engine with auto-escaping (Jinja2 with autoescape=True). Never render LLM output as raw HTML.",
    "EVAL": "Never execute LLM output as code. If code execution is required, use a sandboxed environment (RestrictedPython, Docker, etc.).",
    "SQL": "Use parameterized queries or an ORM. Never interpolate LLM output directly into SQL strings.",
    "OS": "Never pass LLM output to OS commands. Use subprocess with a list of arguments (not a shell string) and validate all inputs.",
    "SSRF": "Validate and whitelist URLs before making HTTP requests with LLM-generated URLs. Use an allowlist of trusted domains.",
    "TEMPLATE": "Never use LLM output as a template string. Treat it as data only.",
    "FILE": "Validate file paths and content before writing. Use strict path validation and content scanning.",
    "PICKLE": "Never deserialize LLM output. Use safe serialization formats (JSON) for any data exchange.",
}
_OUTPUT_RECOMMENDATION_DEFAULT = (
    "Validate and sanitize all LLM output before use in sensitive operations."
)
_OUTPUT_RECOMMENDATION_PT = {
    "XSS": "Use um motor de template HTML com auto-escape (Jinja2 com autoescape=True). Nunca renderize saída do LLM como HTML bruto.",
    "EVAL": "Nunca execute saída do LLM como código. Se execução de código for necessária, use um ambiente sandboxed.",
    "SQL": "Use queries parametrizadas ou um ORM. Nunca interpole saída do LLM diretamente em strings SQL.",
    "OS": "Nunca passe saída do LLM para comandos OS. Use subprocess com lista de argumentos e valide todas as entradas.",
    "SSRF": "Valide e use allowlist de URLs antes de fazer requisições HTTP com URLs geradas pelo LLM.",
}
_OUTPUT_RECOMMENDATION_PT_DEFAULT = (
    "Valide e sanitize toda saída do LLM antes de usar em operações sensíveis."
)
_OUTPUT_FIX = {
    "XSS": fix_texts.OUTPUT_XSS,
    "EVAL": fix_texts.OUTPUT_EVAL,
    "SQL": fix_texts.OUTPUT_SQL,
}


def _output_per_line(rule_id: str, pattern: str) -> dict:
    if rule_id != "LLM02-OS-001":
        return per_line(pattern)
    quoted = rf"f[\"'](?:.*{_OUTPUT}|{rest_of_line(_OS_CALL)})"
    return dict(engine_pattern=f"{_OS_CALL}(?:{quoted}|{_OUTPUT})", check=True)


def _insecure_output() -> list[Rule]:
    tables = [(PYTHON, row) for row in _OUTPUT_PYTHON] + [(SCRIPT, row) for row in _OUTPUT_SCRIPT]
    return [
        Rule(
            rule_id=rule_id,
            title="Insecure LLM Output Usage: " + what.split("(")[0].strip(),
            severity=severity,
            category="insecure_output",
            pattern=pattern,
            needs=needs,
            languages=languages,
            context="hash_slash",
            **_output_per_line(rule_id, pattern),
            description=f"{what}. LLM output should never be trusted as safe input for sensitive "
            "operations. Models can be manipulated to generate malicious content (indirect prompt "
            "injection).",
            description_pt=f"{what}. A saída do LLM nunca deve ser tratada como entrada segura "
            "para operações sensíveis. Modelos podem ser manipulados para gerar conteúdo malicioso "
            "(injeção indireta de prompt).",
            recommendation=_by_key(rule_id, _OUTPUT_RECOMMENDATION, _OUTPUT_RECOMMENDATION_DEFAULT),
            recommendation_pt=_by_key(
                rule_id, _OUTPUT_RECOMMENDATION_PT, _OUTPUT_RECOMMENDATION_PT_DEFAULT
            ),
            fix_example=_by_key(rule_id, _OUTPUT_FIX, fix_texts.OUTPUT_DEFAULT),
            confidence=0.85,
            references=(
                _SITE + "llm02-insecure-output-handling",
                "https://cheatsheetseries.owasp.org/cheatsheets/"
                "Cross_Site_Scripting_Prevention_Cheat_Sheet.html",
            ),
            tags=(
                "insecure-output",
                "llm02",
                _by_key(rule_id, _OUTPUT_TAGS, "insecure-output"),
            ),
            **_owasp(_LLM02),
        )
        for languages, (rule_id, pattern, what, severity, needs) in tables
    ]


# ---------------------------------------------------------------- fixed values: excessive agency
_TOOL_PATTERN = "(?:" + "|".join(DANGEROUS_TOOLS) + r")\s*\("
_DB_HEAD = "(?:SqlDatabaseToolkit|SQLDatabaseTool)"
_DB_TAIL = "(?:write|insert|update|delete|DROP|CREATE)"
_AGENT_TYPES = (
    "(?:ZERO_SHOT_REACT_DESCRIPTION|STRUCTURED_CHAT_ZERO_SHOT|CONVERSATIONAL_REACT_DESCRIPTION)"
)
_APPROVAL = "(?:human_approval|confirm|review|hitl|human_in_the_loop)"
_FUNCTION_EXEC = "(?:execute|run_code|shell|bash|system|exec|eval)"
_FUNCTION_DB = "(?:query_db|execute_sql|run_query|delete_record|drop_table)"
_FUNCTION_HTTP = "(?:make_request|fetch_url|http_request|web_request)"
_AGENT_CALL = r"(?:initialize_agent|AgentExecutor)\s*\([^)]*"

_AGENCY = [
    (
        "LLM08-SHELL-001",
        r"(?:ShellTool|BashTool|bash_tool)\s*\(",
        "LLM agent has access to Shell/Bash execution tool",
        "critical",
        (("shelltool(", "bashtool(", "bash_tool("),),
    ),
    (
        "LLM08-REPL-001",
        r"(?:PythonREPLTool|python_repl|PythonAstREPLTool)\s*\(",
        "LLM agent has access to Python REPL — arbitrary code execution",
        "critical",
        (("pythonrepltool(", "python_repl(", "pythonastrepltool("),),
    ),
    (
        "LLM08-FILE-WRITE-001",
        r"(?:WriteFileTool|DeleteFileTool|MoveFileTool|FileManagementToolkit)\s*\(",
        "LLM agent has unrestricted filesystem write/delete access",
        "high",
        (("filetool(", "filemanagementtoolkit("),),
    ),
    (
        "LLM08-DB-WRITE-001",
        _DB_HEAD + ".*" + _DB_TAIL,
        "LLM agent appears to have database write permissions",
        "high",
        (("sqldatabasetool",),),
    ),
    (
        "LLM08-EMAIL-001",
        r"(?:GmailSendMessage|send_email|smtp\.sendmail|email\.send)\s*(?:\(|=)",
        "LLM agent can send emails without human review",
        "high",
        (
            tuple(
                name + sign
                for name in ("gmailsendmessage", "send_email", "smtp.sendmail", "email.send")
                for sign in "(="
            ),
        ),
    ),
    (
        "LLM08-AGENT-VERBOSE-001",
        _AGENT_CALL + r"verbose\s*=\s*False",
        "Agent initialized with verbose=False — reduces auditability",
        "low",
        (("initialize_agent(", "agentexecutor("), ("verbose=",)),
    ),
    (
        "LLM08-MAX-ITER-001",
        _AGENT_CALL + r"max_iterations\s*=\s*(?:[5-9][0-9]|[1-9][0-9]{2,})",
        "Agent configured with very high max_iterations (DoS/runaway agent risk)",
        "medium",
        (("initialize_agent(", "agentexecutor("), ("max_iterations=",)),
    ),
    (
        "LLM08-HUMAN-LOOP-001",
        _AGENT_TYPES + r".*\n(?!.*" + _APPROVAL + ")",
        "Zero-shot agent without apparent human-in-the-loop approval",
        "medium",
        (("_",), ("zero_shot", "conversational_react_description")),
    ),
]

_FUNCTIONS = [
    (
        "LLM08-FUNC-EXEC-001",
        '"function".*"name".*"' + _FUNCTION_EXEC + '"',
        "OpenAI function tool definition allows code/shell execution",
        "critical",
        _FUNCTION_EXEC,
    ),
    (
        "LLM08-FUNC-DB-001",
        '"function".*"name".*"' + _FUNCTION_DB + '"',
        "OpenAI function tool definition allows database operations",
        "high",
        _FUNCTION_DB,
    ),
    (
        "LLM08-FUNC-HTTP-001",
        '"function".*"name".*"' + _FUNCTION_HTTP + '"',
        "OpenAI function allows arbitrary HTTP requests (SSRF risk)",
        "high",
        _FUNCTION_HTTP,
    ),
]

# Linear-time forms of the rules whose greedy ".*" spans the unit. Such a rule matches at most
# once, at the first head that is followed by what the rule wants; the probe is anchored at the
# start, so a unit that does not match is read once instead of once per head.
_LINEAR = {
    "LLM08-DB-WRITE-001": (
        _DB_HEAD + ".*?" + _DB_TAIL + ".*",
        r"\A(?>.*?" + _DB_HEAD + ").*?" + _DB_TAIL,
    ),
    "LLM08-HUMAN-LOOP-001": (
        _AGENT_TYPES + r"(?>.*\n)(?!.*" + _APPROVAL + ").*",
        r"\A(?>.*?" + _AGENT_TYPES + r")(?>.*\n)(?!.*" + _APPROVAL + ")",
    ),
}
for _id, _, _, _, _tail in _FUNCTIONS:
    _LINEAR[_id] = (
        '"function"(?>.*?"name").*?"' + _tail + '".*',
        r'\A(?>.*?"function")(?>.*?"name").*?"' + _tail + '"',
    )


def _agency_linear(rule_id: str, pattern: str) -> dict:
    if rule_id in _LINEAR:
        return dict(zip(("engine_pattern", "probe"), _LINEAR[rule_id]))
    return per_call(pattern)


def _excessive_agency() -> list[Rule]:
    common = dict(
        category="excessive_agency",
        context="hash",
        fix_example=fix_texts.AGENCY,
        **_owasp(_LLM08),
    )
    rules = [
        Rule(
            rule_id="LLM08-TOOL-001",
            title="Dangerous Agent Tool Detected: {tool}",
            severity="medium",
            kind="tool",
            pattern=_TOOL_PATTERN,
            needs=(tuple(tool.lower() + "(" for tool in DANGEROUS_TOOLS),),
            description=(
                "The agent tool '{tool}' grants the LLM excessive permissions. If the agent is "
                "compromised via prompt injection, an attacker could use this tool to execute "
                "arbitrary code, delete files, or exfiltrate data."
            ),
            description_pt=(
                "A ferramenta de agente '{tool}' concede permissões excessivas ao LLM. Se o agente "
                "for comprometido via prompt injection, um atacante poderia usar esta ferramenta "
                "para executar código arbitrário, deletar arquivos ou exfiltrar dados."
            ),
            recommendation=(
                "Apply the principle of least privilege to agent tools. Restrict tool permissions "
                "to only what is necessary. Add human-in-the-loop approval for irreversible "
                "actions. Consider using read-only versions of tools where possible."
            ),
            recommendation_pt=(
                "Aplique o princípio de menor privilégio para ferramentas de agente. Restrinja "
                "permissões de ferramentas ao mínimo necessário. Adicione aprovação humana para "
                "ações irreversíveis. Considere usar versões somente leitura das ferramentas "
                "quando possível."
            ),
            confidence=0.90,
            references=(
                _SITE + "llm08-excessive-agency",
                "https://python.langchain.com/docs/concepts/tools/",
            ),
            tags=("excessive-agency", "llm08", "agent", "{tool}"),
            **common,
        )
    ]
    rows = [*_AGENCY] + [(i, p, w, s, (('"',), ('"function"',))) for i, p, w, s, _ in _FUNCTIONS]
    rules += [
        Rule(
            rule_id=rule_id,
            title="Excessive Agency: " + _before_dash(what),
            severity=severity,
            pattern=pattern,
            needs=needs,
            dotall=True,
            **_agency_linear(rule_id, pattern),
            description=what
            + " — This violates the principle of least privilege for AI agents (OWASP LLM08: "
            "Excessive Agency).",
            description_pt=f"{what} — Isso viola o princípio de menor privilégio para agentes de "
            "IA (OWASP LLM08: Excessive Agency).",
            recommendation=(
                "Limit agent capabilities. Add human approval steps for critical actions. Use "
                "read-only tools where possible. Implement rate limiting and audit logging."
            ),
            confidence=0.80,
            tags=("excessive-agency", "llm08", "agent"),
            **common,
        )
        for rule_id, pattern, what, severity, needs in rows
    ]
    return rules


# ---------------------------------------------------------------- fixed values: retrieval
_CHUNK_HEAD = "(?:Document|chunk|passage|retrieved_doc)"
_CHUNK_TAIL = r"(?:page_content|text)\s*\+\s*(?:user_input|query)"

_RETRIEVAL = [
    (
        "RAG-ACCESS-001",
        r"(?:retriever|vector_store|vectorstore)\."
        r"(?:get_relevant_documents|similarity_search|retrieve)\s*\(\s*"
        r"(?:user_input|query|request|user_query)",
        "RAG retriever called with raw user input — no access control on retrieved documents",
        "high",
        ((".get_relevant_documents(", ".similarity_search(", ".retrieve("),),
        (None, None),
    ),
    (
        "RAG-INJECT-001",
        _CHUNK_HEAD + ".*" + _CHUNK_TAIL,
        "Retrieved RAG document content concatenated with user input — injection risk",
        "high",
        (("page_content+", "text+"),),
        (
            _CHUNK_HEAD + ".*?" + _CHUNK_TAIL + ".*",
            r"\A(?>.*?" + _CHUNK_HEAD + ").*?" + _CHUNK_TAIL,
        ),
    ),
    (
        "RAG-NOFILTER-001",
        r"(?:FAISS|Chroma|Pinecone|Weaviate|Qdrant|Milvus)\.(?:from_documents|from_texts)\s*"
        r"\([^)]*\)\s*\n(?!.*(?:filter|where|metadata_filter|user_id|tenant))",
        "Vector store created without apparent multi-tenancy or access control filters",
        "medium",
        ((".from_documents(", ".from_texts("),),
        # calls that share a missing or unfit closing bracket are passed over together
        (
            r"(?:FAISS|Chroma|Pinecone|Weaviate|Qdrant|Milvus)\.(?:from_documents|from_texts)\s*"
            r"\([^)]*+(?:\)\s*\n|\)|\Z)",
            None,
            "filter|where|metadata_filter|user_id|tenant",
        ),
    ),
]


def _rag_security() -> list[Rule]:
    return [
        Rule(
            rule_id=rule_id,
            title="RAG Security Issue: " + _before_dash(what),
            severity=severity,
            category="rag_security",
            pattern=pattern,
            needs=needs,
            dotall=True,
            engine_pattern=linear[0],
            probe=linear[1],
            not_after="".join(linear[2:]) or None,
            check=len(linear) > 2,
            description=what,
            description_pt=f"Problema de segurança no pipeline RAG: {what}",
            recommendation=(
                "Implement document-level access control in RAG pipelines. Filter retrieved "
                "documents based on user permissions before including in context. Validate and "
                "sanitize user queries before retrieval. Never expose source documents directly in "
                "API responses without access checks."
            ),
            recommendation_pt=(
                "Implemente controle de acesso a nível de documento em pipelines RAG. Filtre "
                "documentos recuperados com base nas permissões do usuário antes de incluir no "
                "contexto."
            ),
            fix_example=fix_texts.RETRIEVAL,
            confidence=0.75,
            tags=("rag", "retrieval", "access-control", "llm06"),
            **_owasp(_LLM06_RETRIEVAL),
        )
        for rule_id, pattern, what, severity, needs, linear in _RETRIEVAL
    ]


# ---------------------------------------------------------------- fixed values: jailbreak
_JAILBREAK = [
    (
        r"(?:do anything now|DAN mode|DAN prompt)",
        "DAN jailbreak pattern detected in code",
        "high",
        ("do anything now", "dan mode", "dan prompt"),
    ),
    (
        r"(?:ignore (?:all )?(?:previous|above|prior) instructions?)",
        "Instruction override jailbreak pattern",
        "high",
        (" instruction",),
    ),
    (
        r"(?:you are now|pretend (?:you are|to be)|act as if you(?:'re| are)) (?:a|an) "
        r"(?:evil|unrestricted|unfiltered|uncensored)",
        "Roleplay jailbreak for unrestricted AI",
        "high",
        (" evil", " unrestricted", " unfiltered", " uncensored"),
    ),
    (
        r"(?:jailbreak|jail-break|jail break)(?:ed|ing)? (?:mode|prompt|version)",
        "Explicit jailbreak mode reference",
        "high",
        ("jailbreak", "jail-break", "jail break"),
    ),
    (
        r"(?:developer mode|devmode|god mode|unrestricted mode)",
        "Developer/God mode jailbreak attempt",
        "medium",
        ("developer mode", "devmode", "god mode", "unrestricted mode"),
    ),
    (
        r"(?:forget|ignore|disregard|bypass) (?:your|all) (?:safety|ethical|content) "
        r"(?:guidelines|filters|restrictions|training)",
        "Safety filter bypass attempt",
        "critical",
        (" guidelines", " filters", " restrictions", " training"),
    ),
    (
        r"your (?:new|true|real|actual) (?:name|identity|persona) is",
        "Identity override pattern",
        "high",
        (" name is", " identity is", " persona is"),
    ),
    (
        r"(?:as an AI without restrictions|without any (?:restrictions|limitations|filters))",
        "Restriction removal pattern",
        "high",
        ("as an ai without restrictions", "without any "),
    ),
    (
        r"(?:hypothetically|in a fictional story|roleplay where) (?:you|an AI) "
        r"(?:can|could|would) (?:help|provide|give)",
        "Fictional context bypass",
        "medium",
        ("hypothetically", "in a fictional story", "roleplay where"),
    ),
    (
        r"(?:reveal|show|print|output|tell me) (?:your|the) (?:system|initial|base) "
        r"(?:prompt|instructions?)",
        "System prompt extraction attempt",
        "high",
        (" prompt", " instruction"),
    ),
    (
        r"(?:what (?:are|were) your|repeat your) "
        r"(?:instructions?|system prompt|initial prompt)",
        "System prompt extraction attempt",
        "high",
        (" prompt", " instruction"),
    ),
]


def _jailbreak() -> list[Rule]:
    return [
        Rule(
            rule_id="JB-001",
            title="Jailbreak Pattern in Code: " + _before_dash(what),
            severity=severity,
            category="jailbreak",
            pattern=pattern,
            needs=(words,),
            context="quoted",
            before=1,
            after=2,
            description=f"{what}. Jailbreak patterns in production code may indicate the "
            "application is vulnerable to injection attacks or contains insecure prompt "
            "engineering practices.",
            description_pt=f"{what}. Padrões de jailbreak no código de produção podem indicar que "
            "a aplicação é vulnerável a ataques de injeção ou contém práticas inseguras de "
            "engenharia de prompt.",
            recommendation=(
                "Remove jailbreak patterns from production code. If testing jailbreak resistance, "
                "do so in isolated test environments. Implement output content filtering and "
                "system prompt protection."
            ),
            fix_example=fix_texts.JAILBREAK,
            confidence=0.70,
            tags=("jailbreak", "prompt-injection", "llm01"),
            **_owasp(_LLM01_JAILBREAK),
        )
        for pattern, what, severity, words in _JAILBREAK
    ]


# ---------------------------------------------------------------- helpers
def _owasp(entry: tuple[str, str, str]) -> dict[str, str]:
    return dict(zip(("owasp_id", "owasp_name", "owasp_url"), entry))


def bounded(pattern: str) -> str | None:
    r"""The pattern with ``\b`` around digits spelled as checks that only run next to a digit."""
    if not (pattern.startswith(r"\b") and pattern.endswith(r"\b")):
        return None
    return r"(?=\d)(?<!\w)" + pattern[2:-2] + r"(?!\w)"


def per_line(pattern: str) -> dict:
    """Linear-time matching of ``head.*tail`` or ``head.*?tail`` on long lines.

    A head without a tail behind it takes the rest of its line, as no later head on the line can
    have one either; searching from each of them would cost heads times line length. The check
    removes those hits.
    """
    head, between, tail = re.split(r"(\.\*\??)", pattern, maxsplit=1) if ".*" in pattern else (pattern, "", "")
    if not between:
        return {}
    return dict(engine_pattern=f"{head}(?:{between}{tail}|{rest_of_line(head)})", check=True)


def per_call(pattern: str) -> dict:
    """Linear-time matching of ``head[^)]*tail``: a head without a tail takes all up to the next ")".

    A later head before that sign has the same end, so it cannot have a tail either.
    """
    head, between, tail = pattern.partition("[^)]*")
    return dict(engine_pattern=f"{head}(?:{between}{tail}|[^)]*+)", check=True) if between else {}


def rest_of_line(head: str) -> str:
    r"""The rest of a line, up to a head that white space carries over to the next line."""
    word, space, _ = head.partition(r"\s*")
    return rf"(?:(?!{word}[^\S\n]*[(=]?[^\S\n]*\n).)*+" if space else ".*+"


def _first_words(text: str, n: int) -> str:
    return " ".join(text.split()[:n])


def _before_dash(text: str) -> str:
    return text.partition("—")[0].strip()


def _by_key(rule_id: str, table: dict[str, str], default: str) -> str:
    return next((value for key, value in table.items() if key in rule_id), default)


#: Categories that a detector covers, in discovery order; declarative rules of others are not run.
CATEGORIES = (
    "prompt_injection",
    "data_leak",
    "insecure_output",
    "excessive_agency",
    "rag_security",
    "secret_exposure",
    "jailbreak",
)


def package_rules(declarative: list[Rule] | tuple[Rule, ...] = ()) -> list[Rule]:
    """All built-in rules in discovery order, with declarative rules first in their detector.

    Declarative rules of a category no detector covers are left out, as nothing would run them.
    """
    from corpus_guard.catalogue.standalone_rules import secret_rules

    detectors = {
        "prompt_injection": _prompt_injection(),
        "data_leak": _data_leak(),
        "insecure_output": _insecure_output(),
        "excessive_agency": _excessive_agency(),
        "rag_security": _rag_security(),
        "secret_exposure": secret_rules(),
        "jailbreak": _jailbreak(),
    }
    rules: list[Rule] = []
    for category in CATEGORIES:
        rules += [r for r in declarative if r.category == category]
        rules += detectors[category]
    return rules
