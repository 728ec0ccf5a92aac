"""The scan over one text by plain loops, to test the engine against."""

import re

from corpus_guard.catalogue.names import (
    PII_PLACEHOLDER,
    SECRET_PLACEHOLDER,
    SEVERITY_RANK,
    SUPPORTED_LANGUAGES,
    TEST_PATH_WORDS,
    TOOL_SEVERITY,
)

COMMENTS = {
    "none": (),
    "hash": ("#",),
    "slash": ("//", "*"),
    "any": ("#", "//", "*"),
    "hash_slash": ("#", "//"),
}


def matches(rules, text, language="python", path="app.py"):
    """(rule_no, line, column, offset, hit) of every match, by the plain Python patterns."""
    for number, rule in enumerate(rules):
        if rule.kind == "concat" or language not in (rule.languages or SUPPORTED_LANGUAGES):
            continue
        flags = re.I | re.M | (re.S if rule.dotall else 0)
        for m in re.finditer(rule.pattern, text, flags):
            line = text.count("\n", 0, m.start()) + 1
            column = m.start() - text.rfind("\n", 0, m.start()) - 1
            yield number, line, column, m.start(), m.group(0)


def findings(rules, text, language="python", path="app.py", least="info", first_only=True):
    """(rule_no, line, column, tool, snippet) in discovery order."""
    lines = text.splitlines()
    seen = set()
    for number, line, column, _, hit in matches(rules, text, language, path):
        rule = rules[number]
        shown = lines[line - 1] if line <= len(lines) else ""
        if rule.context == "quoted":
            if not any(q in shown for q in ('"', "'", "`", "#", "//")):
                continue
        elif shown.lstrip().startswith(COMMENTS[rule.context] or ("\0",)):
            continue
        if rule.value_filter == "pii" and (
            any(w in path.lower() for w in TEST_PATH_WORDS)
            or re.search(PII_PLACEHOLDER, hit, re.I)
        ):
            continue
        if rule.value_filter == "secret" and re.search(SECRET_PLACEHOLDER, hit, re.I):
            continue
        tool = hit.rstrip("(").strip() if rule.kind == "tool" else None
        severity = TOOL_SEVERITY.get(tool, "medium") if tool else rule.severity
        if SEVERITY_RANK[severity] < SEVERITY_RANK[least]:
            continue
        key = (line, rule.rule_id)
        if first_only and key in seen:
            continue
        seen.add(key)
        around = lines[max(0, line - rule.before - 1) : min(len(lines), line + rule.after)]
        yield number, line, column if rule.column else 0, tool, "\n".join(around)
