"""Regex matching with positions: units in, one row per match out.

A unit is a row with ``unit_id``, ``path``, ``language`` and ``text``. Every rule becomes a literal
in one expression that is evaluated in the scan's own stage: no shuffle, no cross product of units
and rules, one read of the text. What keeps that cheap:

* one regex pass drops units that hold none of the strings any rule requires (``Rule.needs``);
* in the others, each required string is searched once, and a pattern only runs when its strings
  are there;
* positions, lines and snippets are only worked out for units that matched;
* the text is dropped before any row leaves the stage.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.catalogue.model import Rule
from corpus_guard.catalogue.names import SEVERITY_RANK, SUPPORTED_LANGUAGES
from corpus_guard.catalogue.package_rules import THREE_DIGITS
from corpus_guard.functions import text as tx
from corpus_guard.functions.dialect import PYTHON_SPACE, SPACE, to_java

KEY = ["unit_id", "path"]


def match_rules(units: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = KEY) -> DataFrame:
    """Every match of every rule, unfiltered: offset, line, column and the matched text.

    Offsets and columns count characters from 0, lines from 1.
    """
    prepared = ", ".join(str(n) for n, r in enumerate(rules) if r.prepare)
    hit = f"IF(raw.no IN ({prepared}), {tx.as_written('m.hit')}, m.hit)" if prepared else "m.hit"
    hit = f"IF(odd, substring(text, m.offset + 1, char_length(m.hit)), {hit})"
    row = (
        "named_struct('rule_no', raw.no, 'line', m.line, 'column', m.column, 'offset', m.offset, "
        f"'hit', {hit})"
    )
    rows = f"flatten(transform(raws, raw -> transform({_located('raw', rules)}, m -> {row})))"
    located = _over_matches(rules, rules, False, tx.let("odd", f"contains(text, '{_EDGE}')", rows))
    return units.select(*keep, F.inline(F.expr(located)))


def match_findings(
    units: DataFrame,
    rules: Sequence[Rule],
    min_severity: str = "info",
    first_only: bool = True,
    keep: Sequence[str] = KEY,
) -> DataFrame:
    """Matches that survive the context filters, with their snippet.

    ``first_only`` keeps one match per (unit, line, rule id): the first in discovery order among
    those at or above ``min_severity``. That needs no shuffle as long as a unit is one row; use
    ``operators.findings.first_findings`` where other steps come before the de-duplication.
    """
    found = F.expr(findings_array(rules, min_severity, first_only))
    return units.select(*keep, F.inline(found)).drop("rule_group")


def findings_array(
    rules: Sequence[Rule], min_severity: str = "info", first_only: bool = True
) -> str:
    """SQL for the findings of one unit as an array of rows, null if there are none."""
    findings = _surviving(rules, min_severity)
    if first_only:
        findings = _deduplicated(findings)
    return _over_matches(
        rules, at_least(rules, min_severity), True, tx.let("lines", tx.lines_of("text"), findings)
    )


def findings_of(live: str, rules: str, min_severity: str = "info") -> str:
    """SQL for the findings of one unit by rules that are rows, not literals in the plan.

    ``live``: array of (no, pattern in Java's syntax), the rules to run; ``rules``: array with the rank
    of every rule and the number of its id (no), all rules of an id. A finding's rule_no is the place in that array.
    """
    marked = f"regexp_replace(searched, r.pattern, {tx.sql_string(f'{_EDGE}$0{_EDGE}')})"
    raws = _raws(f"transform({live}, r -> named_struct('no', r.no, 'marked', {marked}))")
    settings = f"""transform({rules}, (r, i) -> named_struct('no', i, 'grp', r.no, 'rank', r.rank, 'tool', false,
        'context', 'none', 'value', 'none', 'before', 1, 'after', 1, 'col', true))"""
    found = tx.let("lines", tx.lines_of("text"), _deduplicated(_surviving((), min_severity)))
    found = tx.let("raws", raws, f"IF(size(raws) > 0, {found}, NULL)")
    return tx.let("settings", settings, found)


def at_least(rules: Sequence[Rule], min_severity: str) -> list[Rule]:
    """Rules whose findings can reach a severity; a tool's severity is only known from the hit."""
    least = SEVERITY_RANK.get(min_severity, 0)
    return [r for r in rules if r.kind == "tool" or SEVERITY_RANK[r.severity] >= least]


# ------------------------------------------------------------------ which rules run on a unit
_SETTINGS = (
    "array<struct<no int, grp int, rank int, tool boolean, context string, value string, "
    "before int, after int, col boolean, languages array<string>, needs array<array<string>>>>"
)
_DIGITS = r"\p{Nd}{3}"
_FOLDED = {"s": "sSſ", "i": "iIıİ", "k": "kK\u212a"}


def _over_matches(
    rules: Sequence[Rule], searched: Sequence[Rule], filtered: bool, body: str
) -> str:
    """``body`` over the raw matches of the searched rules in a unit, null for other units.

    ``body`` sees ``raws`` (rule number, hits, gaps) and ``settings`` (by rule number).
    ``filtered`` also skips rules whose context filters no match in the unit could pass.
    """
    wanted = {id(r) for r in searched if r.kind != "concat"}
    numbered = [(n, r) for n, r in enumerate(rules) if id(r) in wanted]
    if not numbered:
        raise ValueError("no rule to match")
    marked = ",\n".join(_marked(n, r) for n, r in numbered)
    raws = _raws(f"array({marked})")
    matched = tx.let("raws", raws, f"IF(size(raws) > 0, {body}, NULL)")
    applies = "array_contains(r.languages, language)"
    if filtered:
        applies += f" AND NOT (r.value = 'pii' AND {tx.is_test_path('path')})"
    live = f"""transform(filter(settings, r -> {applies}
        AND forall(r.needs, alternatives -> arrays_overlap(alternatives, found))), r -> r.no)"""
    matched = tx.let("live", live, f"IF(size(live) > 0, {matched}, NULL)")
    matched = _with_found([r for _, r in numbered], filtered, matched)
    return tx.let("settings", _settings(rules, wanted, filtered), matched)


def _raws(marked: str) -> str:
    """SQL for (no, hits, gaps) of the rules that hit; ``marked`` sees ``searched``, the unit's text."""
    hits = "filter(pieces, (p, i) -> i % 2 = 1)"
    gaps = "filter(pieces, (p, i) -> i % 2 = 0)"
    raw = tx.let(
        "pieces",
        f"split(r.marked, '{_EDGE}', -1)",
        f"named_struct('no', r.no, 'hits', {hits}, 'gaps', {gaps})",
    )
    raws = (
        f"transform(filter({marked}, "
        f"r -> r IS NOT NULL AND contains(r.marked, '{_EDGE}')), r -> {raw})"
    )
    searched = f"IF(contains(text, '{_EDGE}'), replace(text, '{_EDGE}', '{_STAND_IN}'), text)"
    return tx.let("searched", searched, raws)


def _needs(rule: Rule, filtered: bool) -> tuple[tuple[str, ...], ...]:
    if filtered and rule.context == "quoted":
        return (tx.STRING_MARKS, *rule.needs)
    return rule.needs


def _any_sign(word: str) -> str:
    """A required word as it is found: heads do not tell signs apart."""
    return word[:-1] + "(" if len(word) > 1 and word[-1] in _SIGNS else word


def _settings(rules: Sequence[Rule], wanted: set[int], filtered: bool) -> str:
    groups: dict[str, int] = {}
    rows = [
        {
            "no": number,
            "grp": groups.setdefault(rule.rule_id, len(groups)),
            "rank": SEVERITY_RANK[rule.severity],
            "tool": rule.kind == "tool",
            "context": rule.context,
            "value": rule.value_filter,
            "before": rule.before,
            "after": rule.after,
            "col": rule.column,
            "languages": (rule.languages or SUPPORTED_LANGUAGES) if id(rule) in wanted else (),
            "needs": [[_any_sign(w) for w in group] for group in _needs(rule, filtered)],
        }
        for number, rule in enumerate(rules)
    ]
    text = json.dumps(rows, ensure_ascii=False)
    return f"from_json({tx.sql_string(text)}, '{_SETTINGS}')"


def _with_found(rules: Sequence[Rule], filtered: bool, body: str) -> str:
    """Bind ``found``, the required strings a unit holds.

    One regex pass tells units that hold none; those are done unless a rule requires nothing.
    In the others a string is searched where its rule can match, which is rarely the whole text:
    a word before a sign in the words before signs (``heads``), a phrase that only counts inside
    a string or comment in the lines that hold one (``quoted``). And a word is only searched for
    in units with a punctuation mark that some rule wants next to it.
    """
    needs = [_needs(r, filtered) for r in rules]
    marks: dict[str, None] = {}
    gates: dict[tuple[str, str], set[str] | None] = {}
    for rule, groups in zip(rules, needs):
        own_marks = [g for g in groups if all(_is_mark(w) for w in g)]
        for word in (w for group in groups for w in group):
            if _is_mark(word):
                marks[word] = None
            elif word[-1] in _SIGNS:
                marks[word[-1]] = None
                known = gates.get(("heads", _any_sign(word)), set())
                gates["heads", _any_sign(word)] = known | {word[-1]}
            elif word != THREE_DIGITS:
                area = "quoted" if filtered and rule.context == "quoted" else "folded"
                gate = set(own_marks[0]) if own_marks else None
                known = gates.get((area, word), set())
                gates[area, word] = None if gate is None or known is None else known | gate
    free = [word for (_, word), gate in gates.items() if gate is None]
    digits = any((THREE_DIGITS,) in groups for groups in needs)
    if not (free or marks or digits):
        return tx.let("found", _strings(), body)

    found = ["marks"]
    areas = {"heads": _HEADS, "quoted": _QUOTED, "folded": "folded"}
    for area, search_in in areas.items():
        rows = [{"w": w, "m": sorted(g or ())} for (at, w), g in gates.items() if at == area]
        if rows:
            table = tx.sql_string(json.dumps(rows))
            table = f"from_json({table}, 'array<struct<w string, m array<string>>>')"
            wanted = f"filter({table}, r -> size(r.m) = 0 OR arrays_overlap(r.m, marks))"
            held = "transform(filter(wanted, r -> contains(area, r.w)), r -> r.w)"
            held = f"IF(size(wanted) = 0, {_strings()}, {tx.let('area', search_in, held)})"
            found.append(tx.let("wanted", wanted, held))
    if digits:
        run = _strings([THREE_DIGITS])
        found.append(f"IF(text RLIKE {tx.sql_string(_DIGITS)}, {run}, {_strings()})")
    held = tx.let("folded", folded("text"), f"concat({', '.join(found)})")
    held = tx.let("marks", f"filter({_strings(marks)}, m -> contains(text, m))", held)
    gate = tx.sql_string(_any_string(free, marks, digits))
    held = f"IF(text RLIKE {gate}, {held}, {_strings()})"
    if not all(needs):
        return tx.let("found", held, body)
    return tx.let("found", held, f"IF(size(found) > 0, {body}, NULL)")


# Words before a sign, without the white space between and with "(" for any sign: "f = (x)" gives
# "f(" and "(".
_SIGNS = "(=:+"
_HEADS = (
    f"array_join(transform(split(folded, '[{_SIGNS}]', -1), "
    f"piece -> substring_index(rtrim({tx.sql_string(PYTHON_SPACE)}, piece), ' ', -1)), "
    "'(')"
)
# Lines are told by "\n" here; a text with other line breaks is searched whole.
_QUOTED = (
    f"IF({tx.has_odd_break('text')}, folded, array_join(filter("
    "split(folded, '\\n', -1), "
    f"l -> l RLIKE {tx.sql_string('[' + ''.join(m[0] for m in tx.STRING_MARKS) + ']')}), '\\n'))"
)


def _is_mark(word: str) -> bool:
    return word != THREE_DIGITS and not any(c.isalpha() for c in word)


def _strings(words: Sequence[str] = ()) -> str:
    return f"CAST({tx.sql_strings(words)} AS ARRAY<STRING>)"


def _any_string(words: Sequence[str], marks: Sequence[str], digits: bool) -> str:
    """One pattern for any of the strings, ignoring case, that a search leaves quickly in prose.

    A class of all first characters comes first, so the alternatives, told apart by a look-behind,
    are only tried where a string may start.
    """
    by_start: dict[str, list[str]] = {}
    for word in words:
        head, *rest = [_either_case(c) for c in word]
        by_start.setdefault(head, []).append("".join(f"[{c}]" for c in rest))
    single = "".join("\\" + m for m in marks if len(m) == 1)
    choices = [f"(?<=[{head}])(?:{'|'.join(rests)})" for head, rests in by_start.items()]
    choices += [f"(?<=[{single}])"] if single else []
    choices += [r"(?<=\p{Nd})\p{Nd}{2}"] if digits else []
    starts = "".join(by_start) + single + (r"\p{Nd}" if digits else "")
    for mark in (m for m in marks if len(m) > 1):
        starts += "\\" + mark[0]
        choices.append(f"(?<=\\{mark[0]})" + "".join("\\" + c for c in mark[1:]))
    return f"[{starts}](?:{'|'.join(choices)})"


def _either_case(letter: str) -> str:
    if letter.isalpha():
        return _FOLDED.get(letter, letter + letter.upper())
    return letter if letter.isalnum() else "\\" + letter


def folded(text: str) -> str:
    """Lower case, with the letters that match an ASCII letter when case is ignored folded."""
    letters = (("ſ", "s"), ("ı", "i"), ("İ", "i"))
    replaced = text
    for letter, ascii_letter in letters:
        replaced = f"replace({replaced}, '{letter}', '{ascii_letter}')"
    rare = " OR ".join(f"contains({text}, '{letter}')" for letter, _ in letters)
    return f"lower(IF({rare}, {replaced}, {text}))"


# ------------------------------------------------------------------ one rule
# Hits are told from gaps by an edge character put around them in one pass. It is a code point
# reserved for internal use; where a text holds it, another such code point stands in, which every
# pattern takes alike.
_EDGE = "\ufdd0"
_STAND_IN = "\ufdd1"
_START = r"\A"


def _marked(number: int, rule: Rule) -> str:
    """The rule's number and the text with edges around its hits, null where it does not apply."""
    pattern = tx.sql_string(to_java(rule.engine_pattern or rule.pattern, rule.dotall))
    applies = f"array_contains(live, {number})"
    if rule.probe:
        applies += f" AND searched RLIKE {tx.sql_string(to_java(rule.probe, rule.dotall))}"
    replacement = tx.sql_string(f"{_EDGE}$0{_EDGE}")
    source = tx.PREPARED[rule.prepare]("searched") if rule.prepare else "searched"
    return (
        f"IF({applies}, named_struct('no', {number}, "
        f"'marked', regexp_replace({source}, {pattern}, {replacement})), NULL)"
    )


def _located(raw: str, rules: Sequence[Rule]) -> str:
    """An array of (line, column, offset, hit) for a rule's raw matches.

    Hit i follows gap i, so running totals over (previous hit + gap) give where each hit starts.
    """
    checks = " ".join(
        f"WHEN {n} THEN m.hit RLIKE {tx.sql_string(to_java(f'{_START}(?:{r.pattern})', r.dotall))}"
        for n, r in enumerate(rules)
        if r.check
    )
    body = f"""
    zip_with({raw}.hits, arrays_zip(starts, breaks, line_starts), (h, at) -> named_struct(
        'line', at.breaks + 1, 'column', at.starts - at.line_starts,
        'offset', at.starts, 'hit', h))"""
    last_break = (
        "IF(contains(s, '\\n'), get(starts, i) - char_length(substring_index(s, '\\n', -1)), 0)"
    )
    body = tx.let(
        "line_starts",
        tx.running(f"transform(segments, (s, i) -> {last_break})", "greatest(x, y)"),
        body,
    )
    body = tx.let(
        "breaks", tx.running(f"transform(segments, s -> {tx.newlines_in('s')})"), body
    )
    body = tx.let("starts", tx.running("transform(segments, s -> char_length(s))"), body)
    segments = (
        f"transform({raw}.hits, (h, i) -> "
        f"concat(IF(i = 0, '', get({raw}.hits, i - 1)), get({raw}.gaps, i)))"
    )
    placed = tx.let("segments", segments, body)
    if checks:
        placed = f"filter({placed}, m -> CASE {raw}.no {checks} ELSE true END)"
    ends = " ".join(f"WHEN {n} THEN {_last_end(r.not_after)}" for n, r in enumerate(rules) if r.not_after)
    if ends:
        behind = f"filter({placed}, m -> m.offset + char_length(m.hit) >= last)"
        placed = tx.let("last", f"CASE {raw}.no {ends} ELSE 0 END", behind)
    return placed


def _last_end(words: str) -> str:
    """Characters of the text up to the end of the last of some words, 0 without any; one pass."""
    pattern = tx.sql_string(r"\A" + to_java(f".*(?:{words})", dotall=True))
    return f"(char_length(text) - char_length(regexp_replace(text, {pattern}, '')))"


# ------------------------------------------------------------------ context, snippet, first-wins
def _choose(field: str, filters: dict[str, str | None], value: str) -> str:
    cases = " ".join(
        f"WHEN {field} = '{name}' THEN {condition.replace('{value}', value)}"
        for name, condition in filters.items()
        if condition
    )
    return f"CASE {cases} ELSE true END"


def _surviving(rules: Sequence[Rule], min_severity: str) -> str:
    """Findings of all raw matches; needs ``raws``, ``settings`` and ``lines``."""
    tool = f"regexp_extract(m.hit, {tx.sql_string('^[^' + SPACE + '(]+')}, 0)"
    line = tx.line_at("lines", "m.line")
    kept = " AND ".join(
        [
            _choose("rule.context", tx.CONTEXT_FILTERS, line),
            _choose("rule.value", tx.VALUE_FILTERS, "m.hit"),
            f"(NOT rule.tool OR {tx.tool_rank(tool)} >= {SEVERITY_RANK.get(min_severity, 0)})",
        ]
    )
    row = f"""named_struct(
        'rule_group', rule.grp, 'line', m.line, 'rule_no', rule.no, 'offset', m.offset,
        'column', IF(rule.col, m.column, 0), 'tool', IF(rule.tool, {tool}, NULL),
        'code_snippet', {tx.snippet('lines', 'm.line', 'rule.before', 'rule.after')})"""
    rows = f"transform(filter({_located('raw', rules)}, m -> {kept}), m -> {row})"
    return f"flatten(transform(raws, raw -> {tx.let('rule', 'get(settings, raw.no)', rows)}))"


def _deduplicated(findings: str) -> str:
    """The first finding per rule id and line, by sorting on (rule group, line, rule, offset)."""
    return tx.let(
        "fs",
        f"array_sort({findings})",
        "filter(fs, (f, i) -> i = 0 OR f.rule_group <> get(fs, i - 1).rule_group"
        " OR f.line <> get(fs, i - 1).line)",
    )
