"""Tainted string concatenation: ``+`` of a user-controlled name and a prompt or literal.

The operands of every ``+`` come out as rows (line, kind and name of each side), and the taint
rule is a condition on those rows. Of a chain ``a + b + c`` only ``a`` and ``b`` are compared.

The text is read in steps, each linear in it and only in units that hold a tainted name and a "+":

1. One pattern marks string literals and comments from left to right. Literals become ``""`` (or
   ``b""``), comments nothing, f-strings a call of their embedded expressions.
2. Running totals of brackets by line join the lines of an open bracket, and a backslash joins its
   line with the next, so an expression over several lines is one logical line. In a unit whose
   brackets do not balance, as in prose, only backslashes join.
3. On each logical line another pattern finds the operands: names, dotted names, literals and
   numbers, in parentheses or not. Calls, subscripts, products and f-strings are other expressions.

A unit need not parse as a whole, so fragments of code in prose are read too; with ``whole`` units whose
brackets or quotes do not close are left out. An attribute of a call or a subscript is not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.catalogue.model import Rule
from corpus_guard.catalogue.names import PROMPT_NAMES, TAINTED_NAMES
from corpus_guard.functions import text as tx
from corpus_guard.operators.matching import KEY

# Code points reserved for internal use: around what a pattern hits, for a line break inside a
# logical line, and before the embedded expressions of an f-string. Texts that hold them get another.
_EDGE, _JOINED, _FORMATTED, _OTHER = "\ufdd0", "\ufdd2", "\ufdd3", "\ufdd1"

# ------------------------------------------------------------------ literals and comments
_QUOTED = r""""[^"\n]*+"|'[^'\n]*+'"""
_LEXEME = (
    r"(?:(?<![A-Za-z0-9_])[rRbBuUfFtT]{1,2})?"
    r"""(?:"{3}(?:[^"]++|"(?!""))*+"{3}|'{3}(?:[^']++|'(?!''))*+'{3}|""" + _QUOTED + ")"
    rf"|#[^\n{_JOINED}]*+"
)
_QUOTES = r"""^[A-Za-z]+(?:"{3}|'{3}|["'])|(?:"{3}|'{3}|["'])$"""


def _count(value: str, chars: str) -> str:
    """SQL for how many of some characters a value holds."""
    return f"(char_length({value}) - char_length(translate({value}, {tx.sql_string(chars)}, '')))"


def _replaced(value: str, pattern: str, by: str) -> str:
    return f"regexp_replace({value}, {tx.sql_string(pattern)}, {tx.sql_string(by)})"


def _breaks(value: str) -> str:
    """SQL for the line breaks of a value, all joined."""
    both = "\n" + _JOINED
    return f"repeat('{_JOINED}', {_count(value, both)})"


def _lexeme(hit: str) -> str:
    """SQL for what stands for a literal or comment; its line breaks stay as joined ones."""
    prefix = f"regexp_extract({hit}, '^[A-Za-z]*', 0)"
    body = f"replace(replace({_replaced(hit, _QUOTES, '')}, '{{{{', ''), '}}}}', '')"
    body = _replaced(body, r":[^{}]*[{][^{}]*[}]", "")
    # an embedded expression without its strings, subscripts, conversion and format
    inner = _replaced(_replaced("x", _QUOTED, '""'), r"\[[^\[\]]*\]", "[]")
    inner = _replaced(f"substring_index({inner}, ':', 1)", r"![rsa][ ]*$", "")
    inner = f"translate({inner}, {tx.sql_string(chr(10))}, '{_JOINED}')"
    parts = f"transform(split({body}, '[{{}}]', -1), (x, i) -> IF(i % 2 = 1, {inner}, concat(',', {_breaks('x')})))"
    return f"""CASE WHEN startswith({hit}, '#') THEN ''
        WHEN {prefix} RLIKE '[fFtT]' THEN concat('{_FORMATTED}(', array_join({parts}, ''), ')')
        WHEN {prefix} RLIKE '[bB]' THEN concat('b""', {_breaks(hit)})
        ELSE concat('""', {_breaks(hit)}) END"""


# ------------------------------------------------------------------ logical lines
def logical_lines(text: str, whole: bool = False) -> str:
    """SQL for an array of (line, code): the logical lines of a text and the lines they start on.

    Code has literals emptied and comments cut, and ``_JOINED`` where a line break was joined. With
    ``whole`` the array is empty if a bracket or a quote does not close.
    """
    newline = tx.sql_string("\n")
    balanced = "(element_at(depth, -1) = 0 AND array_min(depth) >= 0)"
    joined = f"array_join(zip_with(ls, depth, (l, d) -> concat(l, IF(d > 0, '{_JOINED}', {newline}))), '')"
    joined = f"split({_replaced(joined, chr(10) + r'\z', '')}, {newline}, -1)"
    logical = f"IF({balanced} AND array_max(depth) > 0, {joined}, ls)"
    first = f"named_struct('line', e - {_count('l', _JOINED)}, 'code', l)"
    body = f"zip_with(logical, ends, (l, e) -> {first})"
    body = tx.let("ends", tx.running(f"transform(logical, l -> 1 + {_count('l', _JOINED)})"), body)
    body = tx.let("logical", logical, body)
    if whole:
        none = "CAST(array() AS ARRAY<STRUCT<line: INT, code: STRING>>)"
        quote = tx.sql_string("[\"']")
        stray = f"exists(filter(pieces, (p, i) -> i % 2 = 0), p -> p RLIKE {quote})"
        body = f"IF({balanced} AND NOT {stray}, {body}, {none})"
    depth = tx.running(f"transform(ls, l -> {_count('l', '([{')} - {_count('l', ')]}')})")
    body = tx.let("ls", f"split(code, {newline}, -1)", tx.let("depth", depth, body))
    code = f"array_join(transform(pieces, (p, i) -> IF(i % 2 = 0, p, {_lexeme('p')})), '')"
    marked = _replaced("plain", _LEXEME, f"{_EDGE}$0{_EDGE}")
    body = tx.let("pieces", f"split({marked}, '{_EDGE}', -1)", tx.let("code", code, body))
    # an escaped character says nothing; the backslashes that are left join two lines
    backslash = tx.sql_string("\\")
    plain = f"replace({_replaced('src', r'\\[^\n]', '')}, {tx.sql_string(chr(92) + chr(10))}, '{_JOINED}')"
    body = tx.let("plain", f"IF(contains(src, {backslash}), {plain}, src)", body)
    src = f"IF({tx.has_odd_break(text)}, {_replaced(text, tx.LINE_BREAK, chr(10))}, {text})"
    return tx.let("src", f"translate({src}, '{_EDGE}{_JOINED}{_FORMATTED}', '{_OTHER * 3}')", body)


# ------------------------------------------------------------------ operands
_SPACE = rf"[ \t\f{_JOINED}]*+"
_NAME = r"[A-Za-z_][A-Za-z0-9_.]*+"
_NUMBER = (
    r"(?:0[xXoObB][0-9A-Fa-f_]++|(?:[0-9][0-9_]*+\.?[0-9_]*+|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9_]++)?[jJ]?)"
)
_CONSTANT = rf'b""|(?:True|False|None)(?![A-Za-z0-9_.])|\.\.\.|{_NUMBER}'
_OPERAND = rf'(?:""|{_CONSTANT}|{_NAME})'
#: What a sum can follow: a bracket, an operator that binds less, a keyword.
_BEFORE = (
    r"(?:^|[=(,:\[{<>&|^;]|(?<![A-Za-z0-9_.])(?:return|yield|from|in|is|and|or|not|if|elif|else|while|"
    r"assert|raise|with)(?![A-Za-z0-9_]))" + _SPACE
)
_PARENTHESISED = rf"({_BEFORE}|\+{_SPACE})\(({_SPACE})({_OPERAND})({_SPACE})\)"
_PAIR = (
    rf"({_BEFORE})({_OPERAND}){_SPACE}\+{_SPACE}({_OPERAND})(?![A-Za-z0-9_.\"'(\[])"
    rf'(?!{_SPACE}[*/%@(\["{_FORMATTED}])'
)


def operands(text: str, whole: bool = False) -> str:
    """SQL for the operand rows: those of the first ``+`` of every chain, by the line it starts on."""
    pair, constant = tx.sql_string(_PAIR), tx.sql_string(f"^(?:{_CONSTANT})$")

    def side(n: int, name: str) -> str:
        operand = f"regexp_extract(p, {pair}, {n})"
        return f"""
            '{name}_kind', CASE WHEN {operand} = '""' THEN 'string'
                                WHEN {operand} RLIKE {constant} THEN 'constant'
                                WHEN contains({operand}, '.') THEN 'attribute' ELSE 'name' END,
            '{name}', IF({operand} = '""' OR {operand} RLIKE {constant}, '', substring_index({operand}, '.', -1))"""

    # literals in a row are one; an operand in parentheses is that operand, twice at most
    bare = _replaced("s.code", rf'(?<="")({_SPACE})b?""', "$1")
    for _ in range(2):
        bare = _replaced(bare, _PARENTHESISED, "$1$3$2$4")
    hits = f"split({_replaced(bare, _PAIR, f'{_EDGE}$0{_EDGE}')}, '{_EDGE}', -1)"
    line = f"s.line + IF(i > 0, get(joined, i - 1), 0) + {_count(f'regexp_extract(p, {pair}, 1)', _JOINED)}"
    row = f"named_struct('line', CAST({line} AS INT), {side(2, 'left')}, {side(3, 'right')})"
    rows = f"filter(transform(hits, (p, i) -> IF(i % 2 = 1, {row}, NULL)), r -> r IS NOT NULL)"
    rows = tx.let("joined", tx.running(f"transform(hits, h -> {_count('h', _JOINED)})"), rows)
    sums = f"filter({logical_lines(text, whole)}, s -> contains(s.code, '+'))"
    return f"flatten(transform({sums}, s -> {tx.let('hits', hits, rows)}))"


# ------------------------------------------------------------------ findings
def may_concatenate(rule: Rule) -> str:
    """SQL condition: the unit's language is the rule's, and it has a "+" and a tainted name."""
    languages = ", ".join(tx.sql_string(x) for x in rule.languages)
    names = rf"(?<![A-Za-z0-9_])(?:{'|'.join(TAINTED_NAMES)})(?![A-Za-z0-9_])"
    return (
        f"(language IN ({languages}) AND contains(text, '+') "
        f"AND text RLIKE {tx.sql_string(names)})"
    )


def concat_array(
    rule_no: int,
    rule: Rule,
    attributes: bool = True,
    literals: Sequence[str] = ("string",),
    whole: bool = False,
) -> str:
    """SQL for the concatenation findings of one unit, rows as in ``matching.findings_array``.

    ``attributes`` lets ``obj.name`` count as tainted by its last part; ``literals`` are the kinds of
    constant that count as prompt text; ``whole`` leaves out units that cannot parse.
    """

    def tainted(side: str) -> str:
        kinds = "'name', 'attribute'" if attributes else "'name'"
        names = ", ".join(tx.sql_string(n) for n in TAINTED_NAMES)
        return f"(s.{side}_kind IN ({kinds}) AND s.{side} IN ({names}))"

    def prompt(side: str) -> str:
        names = ", ".join(tx.sql_string(n) for n in PROMPT_NAMES)
        kinds = ", ".join(tx.sql_string(k) for k in literals)
        return (
            f"((s.{side}_kind = 'name' AND s.{side} IN ({names})) OR s.{side}_kind IN ({kinds}))"
        )

    hit = f"{tainted('left')} AND {prompt('right')} OR {tainted('right')} AND {prompt('left')}"
    at_lines = f"array_sort(array_distinct(transform(filter({operands('text', whole)}, s -> {hit}), s -> s.line)))"
    row = f"""named_struct(
        'rule_group', -1, 'line', n, 'rule_no', {rule_no}, 'offset', 0, 'column', 0,
        'tool', CAST(NULL AS STRING),
        'code_snippet', {tx.snippet('lines', 'n', str(rule.before), str(rule.after))})"""
    rows = tx.let("lines", tx.lines_of("text"), f"transform({at_lines}, n -> {row})")
    return f"IF({may_concatenate(rule)}, {rows}, NULL)"


def concat_findings(
    units: DataFrame, rule_no: int, rule: Rule, keep: Sequence[str] = KEY, **options
) -> DataFrame:
    """One match per line with a tainted concatenation, shaped like ``match_findings``."""
    found = F.expr(concat_array(rule_no, rule, **options))
    return units.select(*keep, F.inline(found)).drop("rule_group")
