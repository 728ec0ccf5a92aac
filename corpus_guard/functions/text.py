"""Text expressions: SQL literals, lines, snippets, running totals and context filters.

Matching builds one large SQL expression, so the helpers here return SQL text. ``let`` binds a
value to a name: Spark evaluates a lambda argument once, wherever the optimizer moves things.
"""

from __future__ import annotations

from collections.abc import Iterable

from corpus_guard.catalogue.model import DEAD_F, DEAD_QUOTE, LIVE_BRACE
from corpus_guard.catalogue.names import (
    PII_PLACEHOLDER,
    SECRET_PLACEHOLDER,
    SEVERITY_RANK,
    TEST_PATH_WORDS,
    TOOL_SEVERITY,
)
from corpus_guard.functions.dialect import SPACE, to_java

# What str.splitlines() breaks lines at. Line numbers count "\n" only; line texts use these.
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def sql_string(value: str) -> str:
    """A SQL string literal; "$" is escaped because Spark substitutes "${...}" in SQL text."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return f"'{escaped}'"


def sql_strings(values: Iterable[str]) -> str:
    """A SQL array literal of strings."""
    return "array(" + ", ".join(sql_string(v) for v in values) + ")"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def has_odd_break(text: str) -> str:
    """Whether a text has line breaks other than "\\n"."""
    latin = sql_string(r"[\x0b\x0c\r\x1c-\x1e\x85]")
    return f"({text} RLIKE {latin} OR contains({text}, '\u2028') OR contains({text}, '\u2029'))"


def lines_of(text: str) -> str:
    """The lines of a text: no break characters, no empty line after a final break."""
    pieces = (
        f"IF({has_odd_break(text)}, split({text}, {sql_string(LINE_BREAK)}, -1), "
        f"split({text}, '\\n', -1))"
    )
    trimmed = "IF(element_at(ls, -1) = '', slice(ls, 1, size(ls) - 1), ls)"
    return let("ls", pieces, trimmed)


def line_at(lines: str, number: str) -> str:
    """The text of a 1-based line, empty if there is none."""
    return f"coalesce(get({lines}, {number} - 1), '')"


def snippet(lines: str, number: str, before: str, after: str) -> str:
    """The lines around a 1-based line, clipped at both ends of the text."""
    first = f"greatest(1, {number} - {before})"
    last = f"least(size({lines}), {number} + {after})"
    return f"array_join(slice({lines}, {first}, greatest(0, {last} - {first} + 1)), '\\n')"


def newlines_in(text: str) -> str:
    return f"(char_length({text}) - char_length(replace({text}, '\\n', '')))"


def running(values: str, combine: str = "x + y") -> str:
    """Running totals of an int array by doubling steps: n log n, where a fold would be n².

    ``combine`` merges two neighbouring totals and must be associative with 0 as neutral element.
    """
    steps = "sequence(0, CAST(ceil(log2(size(vs))) AS INT) - 1)"
    shifted = "slice(concat(array_repeat(0, CAST(shiftleft(1, j) AS INT)), acc), 1, size(acc))"
    fold = (
        f"aggregate(IF(size(vs) < 2, array(), {steps}), vs, "
        f"(acc, j) -> zip_with({shifted}, acc, (x, y) -> {combine}))"
    )
    return let("vs", values, fold)


# A match only counts as inside a string or comment on a line that holds one of these.
STRING_MARKS = ('"', "'", "`", "#", "//")

# How a rule treats the line its match starts on; the value is a condition to keep the match.
_INDENT = f"^[{SPACE}]*"
CONTEXT_FILTERS = {
    "none": None,
    "hash": "NOT {value} RLIKE " + sql_string(_INDENT + "#"),
    "slash": "NOT {value} RLIKE " + sql_string(_INDENT + r"(?://|\*)"),
    "any": "NOT {value} RLIKE " + sql_string(_INDENT + r"(?:#|//|\*)"),
    "hash_slash": "NOT {value} RLIKE " + sql_string(_INDENT + "(?:#|//)"),
    "quoted": "{value} RLIKE " + sql_string("|".join(STRING_MARKS)),
}

# Conditions on the matched text.
VALUE_FILTERS = {
    "none": None,
    "pii": "NOT {value} RLIKE " + sql_string(to_java(PII_PLACEHOLDER)),
    "secret": "NOT {value} RLIKE " + sql_string(to_java(SECRET_PLACEHOLDER)),
}


def is_test_path(path: str) -> str:
    """Whether a path contains a test-like word anywhere."""
    return f"lower({path}) RLIKE {sql_string('|'.join(TEST_PATH_WORDS))}"


def tool_rank(tool: str) -> str:
    """Severity rank of an agent tool, by its exact name."""
    cases = " ".join(
        f"WHEN {sql_string(name)} THEN {SEVERITY_RANK[severity]}"
        for name, severity in TOOL_SEVERITY.items()
    )
    return f"CASE {tool} {cases} ELSE {SEVERITY_RANK['medium']} END"


# Rewritings of a text for rules that look ahead from many places (``Rule.prepare``). What a head must
# find is marked once, so that each head is decided where it stands.


def live_literals(text: str, tail: str) -> str:
    """SQL for a text in which the braces, f and ' that ``tail`` can follow are told from others.

    A brace with a tail behind it on its line becomes ``LIVE_BRACE``. Behind the last tail of a line, f
    becomes ``DEAD_F``; behind the last live brace before a double quote, ' becomes ``DEAD_QUOTE``.
    """
    before = f"regexp_extract(l, {sql_string('^(.*)' + to_java(f'(?:{tail})'))}, 1)"
    line = (
        f"concat(translate(b, '{{', '{LIVE_BRACE}'), "
        f"translate(substring(l, char_length(b) + 1), 'fF', '{DEAD_F}'))"
    )
    line = f"IF(l RLIKE {sql_string(to_java(tail))}, {let('b', before, line)}, translate(l, 'fF', '{DEAD_F}'))"
    lines = f"array_join(transform(split({text}, '\\n', -1), l -> {line}), '\\n')"
    quote = sql_string("'")
    rest = f"substring_index(s, '{LIVE_BRACE}', -1)"
    dead = f"translate({rest}, {quote}, '{DEAD_QUOTE}')"
    part = f"IF(contains(s, '{LIVE_BRACE}'), concat(left(s, char_length(s) - char_length({rest})), {dead}), {dead})"
    return f"array_join(transform(split({lines}, '\"', -1), s -> {part}), '\"')"


def as_written(prepared: str) -> str:
    """SQL for a piece of a rewritten text as it was."""
    plain = sql_string("{fF'")
    return f"translate({prepared}, '{LIVE_BRACE}{DEAD_F}{DEAD_QUOTE}', {plain})"


PREPARED = {
    "live_literals": lambda text: live_literals(text, "llm_response|response|output|result|generated|completion"),
}
