"""SQL for DuckDB that yields what the scan yields.

Its regular expressions have no look-around and read ``\\s``, ``\\w`` and ``\\b`` as ASCII. Rules
with a look-ahead are stated by conditions on the text around a match instead.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from corpus_guard.catalogue.model import Rule
from corpus_guard.catalogue.names import (
    PII_PLACEHOLDER,
    PROMPT_NAMES,
    SECRET_PLACEHOLDER,
    SEVERITY_RANK,
    SUPPORTED_LANGUAGES,
    TAINTED_NAMES,
    TEST_PATH_WORDS,
    TOOL_SEVERITY,
)

CONTEXTS = {
    "hash": r"NOT regexp_matches(line_text, '^\s*#')",
    "slash": r"NOT regexp_matches(line_text, '^\s*(//|\*)')",
    "any": r"NOT regexp_matches(line_text, '^\s*(#|//|\*)')",
    "hash_slash": r"NOT regexp_matches(line_text, '^\s*(#|//)')",
    "quoted": r"regexp_matches(line_text, '[\x22\x27`#]|//')",
}
BREAKS = r"'\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rank(column: str = "severity") -> str:
    cases = " ".join(f"WHEN '{s}' THEN {n}" for s, n in SEVERITY_RANK.items())
    return f"CASE {column} {cases} ELSE 0 END"


def pattern(rule: Rule) -> str:
    body = rule.pattern.replace("[^]]", r"[^\]]")
    return text(("(?is)" if rule.dotall else "(?i)") + body)


def _raw(number: int, rule: Rule) -> str:
    """(rule_no, unit, text, hits, gaps, after): ``after`` must not match behind a hit."""
    languages = ", ".join(text(x) for x in rule.languages or SUPPORTED_LANGUAGES)
    where = f"language IN ({languages})"
    after = "NULL::VARCHAR"
    ahead = re.search(r"\\n\(\?!\.\*(\(\?:[^()]*\))\)$", rule.pattern)
    if rule.rule_id == "LLM08-HUMAN-LOOP-001":
        # the head of the pattern before the last line, none of the words on the last line
        head = text("(?i)" + rule.pattern.partition(".*")[0])
        hits, gaps = (f"[regexp_extract(text, {head})]", f"[string_split_regex(text, {head})[1]]")
        before_last = r"regexp_replace(text, '\n[^\n]*\z', '')"
        where += (
            f" AND contains(text, chr(10)) AND regexp_matches({before_last}, {head})"
            rf" AND NOT regexp_matches(regexp_extract(text, '[^\n]*\z'), {text('(?i)' + ahead[1])})"
        )
    else:
        p = pattern(rule)
        if ahead:
            p = text("(?is)" + rule.pattern[: ahead.start()] + r"\n")
            after = text("(?i)" + ahead[1])
        hits, gaps = f"regexp_extract_all(text, {p})", f"string_split_regex(text, {p})"
        where += f" AND regexp_matches(text, {p})"
    return (
        f"SELECT {number} AS rule_no, unit_id, path, text, {hits} AS hits, {gaps} AS gaps, "
        f"{after} AS after FROM units WHERE {where}"
    )


def matches_cte(rules: Sequence[Rule], units: str) -> str:
    """CTEs up to ``matches``: every match with offset, line and column."""
    raws = "\nUNION ALL ".join(
        _raw(n, r) for n, r in enumerate(rules) if r.kind != "concat"
    )
    return rf"""WITH units AS MATERIALIZED ({units}),
raws AS ({raws}),
hits AS (SELECT rule_no, unit_id, path, text, after, hits, gaps,
                unnest(range(1, len(hits) + 1)) AS i FROM raws),
placed AS (SELECT rule_no, unit_id, path, text, after, hits[i] AS hit,
                  array_to_string(list_transform(range(1, i), lambda k: gaps[k] || hits[k]), '')
                  || gaps[i] AS pre FROM hits),
matches AS (SELECT rule_no, unit_id, path, text, hit, length(pre)::INTEGER AS "offset",
                   (length(pre) - length(replace(pre, chr(10), '')) + 1)::INTEGER AS line,
                   length(regexp_extract(pre, '[^\n]*\z'))::INTEGER AS "column"
            FROM placed
            WHERE after IS NULL
               OR NOT regexp_matches(substring(text, length(pre) + length(hit) + 1), after))"""


def rules_values(rules: Sequence[Rule]) -> str:
    rows = []
    for number, r in enumerate(rules):
        pattern_no = sum(x.rule_id == r.rule_id for x in rules[:number])
        values = [
            text(v)
            for v in (
                r.rule_id,
                r.severity,
                r.category,
                r.kind,
                r.context,
                r.value_filter,
                r.detected_by,
                r.title,
                r.description,
                r.description_pt,
                r.recommendation,
                r.recommendation_pt,
                r.fix_example,
                ",".join(r.tags),
                ",".join(r.references),
            )
        ]
        owasp = [
            text(v or "") if r.owasp_id else "NULL"
            for v in (r.owasp_id, r.owasp_name, r.owasp_url)
        ]
        numbers = [str(x) for x in (number, pattern_no, r.before, r.after, f"{r.confidence}::DOUBLE")]
        rows.append(f"({', '.join([*numbers, str(r.column).lower(), *owasp, *values])})")
    return (
        "(VALUES " + ",\n".join(rows) + ") AS r(rule_no, pattern_no, before, after_lines, confidence, "
        "with_column, owasp_id, owasp_name, owasp_url, rule_id, rule_severity, category, kind, "
        "context, value_filter, detected_by, title, description, description_pt, recommendation, "
        "recommendation_pt, fix_example, tags, refs)"
    )


def findings_cte(
    rules: Sequence[Rule],
    units: str,
    least: str = "low",
    first_only: bool = True,
    attributes: bool = True,
    literals: Sequence[str] = ("string",),
) -> str:
    """CTEs up to ``findings``: filtered, joined with rule metadata, first per line and rule id."""
    tool = r"regexp_extract(hit, '^\w+')"
    tool_severity = (
        f"CASE {tool} "
        + " ".join(f"WHEN {text(t)} THEN {text(s)}" for t, s in TOOL_SEVERITY.items())
        + " ELSE 'medium' END"
    )
    contexts = " ".join(f"WHEN {text(c)} THEN {sql}" for c, sql in CONTEXTS.items())
    qualify = (
        """QUALIFY row_number() OVER (PARTITION BY unit_id, path, line, rule_id
                          ORDER BY rule_no, "offset") = 1"""
        if first_only
        else ""
    )
    test_path = text("|".join(TEST_PATH_WORDS))
    sums = _sums_cte(rules, attributes, literals)
    return f"""{matches_cte(rules, units)},
rules AS MATERIALIZED (SELECT * FROM {rules_values(rules)}),
{sums}
every AS (SELECT rule_no, unit_id, path, text, hit, "offset", line, "column" FROM matches
          UNION ALL SELECT rule_no, unit_id, path, text, '', 0, line, 0 FROM sums),
cut AS (SELECT *, string_split_regex(text, {BREAKS}) AS pieces FROM every),
lined AS (SELECT * EXCLUDE (pieces),
                 CASE WHEN pieces[-1] = '' THEN pieces[:-2] ELSE pieces END AS lines FROM cut),
judged AS (SELECT m.*, r.* EXCLUDE (rule_no), coalesce(lines[line], '') AS line_text,
                  CASE WHEN kind = 'tool' THEN {tool_severity} ELSE rule_severity END AS severity,
                  CASE WHEN kind = 'tool' THEN {tool} END AS tool
           FROM lined m JOIN rules r USING (rule_no)),
findings AS (SELECT rule_no, pattern_no, unit_id, path, line, "offset", rule_id, severity, category, confidence,
                    detected_by, tool, owasp_id, owasp_name, owasp_url, recommendation,
                    recommendation_pt, fix_example, refs,
                    CASE WHEN with_column THEN "column" ELSE 0 END AS "column",
                    replace(title, '{{tool}}', coalesce(tool, '')) AS title,
                    replace(description, '{{tool}}', coalesce(tool, '')) AS description,
                    replace(description_pt, '{{tool}}', coalesce(tool, '')) AS description_pt,
                    replace(tags, '{{tool}}', coalesce(lower(tool), '')) AS tags,
                    array_to_string(lines[greatest(1, line - before)
                                          : least(len(lines), line + after_lines)], chr(10))
                    AS code_snippet
             FROM judged
             WHERE CASE context {contexts} ELSE true END
               AND CASE value_filter
                   WHEN 'pii' THEN NOT regexp_matches(lower(path), {test_path})
                                   AND NOT regexp_matches(hit, {text('(?i)' + PII_PLACEHOLDER)})
                   WHEN 'secret' THEN NOT regexp_matches(hit, {text('(?i)' + SECRET_PLACEHOLDER)})
                   ELSE true END
               AND {rank()} >= {SEVERITY_RANK.get(least, 0)}
             {qualify})"""


_JOINED, _FORMATTED = "\ufdd2", "\ufdd3"


def operands_cte() -> str:
    """CTE ``operands`` over ``units``: sides of the first "+" of every chain, lines put together.

    Literals and comments are cut out of the text first. Lines are grouped by a running count of
    brackets; a logical line is cut at its plus signs. The last word of a part and the first of the
    next one are the sides, if what stands before the one and behind the other allows it.
    """
    number = r"0[xXoObB][0-9A-Fa-f_]+|([0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)([eE][+-]?[0-9_]+)?[jJ]?"
    constant = rf"b\x22\x22|True|False|None|\.\.\.|{number}"
    word = rf"\x22\x22|b\x22\x22|\.\.\.|{number}|[A-Za-z_][A-Za-z0-9_.]*"
    words_before = "return|yield|from|in|is|and|or|not|if|elif|else|while|assert|raise|with"
    opens = rf"[=(,:\[{{<>&|^;]$|(^|[^A-Za-z0-9_.])({words_before})$"
    lexeme = (
        r"(\b[rRbBuUfFtT]{1,2})?(\x22{3}([^\x22]|\x22[^\x22]|\x22\x22[^\x22])*\x22{3}|"
        r"\x27{3}([^\x27]|\x27[^\x27]|\x27\x27[^\x27])*\x27{3}|\x22[^\x22\n]*\x22|\x27[^\x27\n]*\x27)"
        rf"|#[^\n{_JOINED}]*"
    )
    space = rf"[ \t\f{_JOINED}]"
    blank = rf"' ' || chr(9) || chr(12) || '{_JOINED}'"

    def joins(value: str) -> str:
        return rf"regexp_replace({value}, '[^\n{_JOINED}]', '', 'g')"

    def lines_in(value: str) -> str:
        return f"length({joins(value)})"

    inner = r"regexp_replace(regexp_replace(x, '\x22[^\x22\n]*\x22|\x27[^\x27\n]*\x27', chr(34) || chr(34), 'g'), '\[[^\[\]]*\]', '[]', 'g')"
    inner = rf"replace(regexp_replace(string_split({inner}, ':')[1], '![rsa] *$', ''), chr(10), '{_JOINED}')"
    body = r"regexp_replace(regexp_replace(h, '^[A-Za-z]+(\x22{3}|\x27{3}|\x22|\x27)', ''), '(\x22{3}|\x27{3}|\x22|\x27)$', '')"
    body = rf"regexp_replace(replace(replace({body}, '{{{{', ''), '}}}}', ''), ':[^{{}}]*\{{[^{{}}]*\}}', '', 'g')"
    embedded = (
        f"array_to_string(list_transform(string_split_regex({body}, '[{{}}]'), "
        f"lambda x, k: CASE WHEN k % 2 = 0 THEN {inner} ELSE ',' || repeat('{_JOINED}', {lines_in('x')}) END), '')"
    )
    stands = f"""CASE WHEN starts_with(h, '#') THEN ''
        WHEN regexp_matches(h, '^[A-Za-z]?[fFtT]') THEN '{_FORMATTED}(' || {embedded} || ')'
        WHEN regexp_matches(h, '^[A-Za-z]?[bB]') THEN 'b""' || repeat('{_JOINED}', {lines_in('h')})
        ELSE '""' || repeat('{_JOINED}', {lines_in('h')}) END"""

    def kind(name: str) -> str:
        return rf"""CASE WHEN {name}_word = '""' THEN 'string'
                        WHEN regexp_full_match({name}_word, '{constant}') THEN 'constant'
                        WHEN contains({name}_word, '.') THEN 'attribute' ELSE 'name' END AS {name}_kind,
                   CASE WHEN {name}_word = '""' OR regexp_full_match({name}_word, '{constant}') THEN ''
                        ELSE list_last(string_split({name}_word, '.')) END AS "{name}" """

    def bare_head(value: str) -> str:
        return rf"regexp_replace({value}, '\({space}*({word}){space}*\)$', ' \1')"

    def bare_tail(value: str) -> str:
        return rf"regexp_replace({value}, '^\({space}*({word}){space}*\)', '\1')"

    def inner_bare(value: str) -> str:
        return rf"regexp_replace({value}, '\({space}*\(({space}*({word}){space}*)\){space}*\)', '(\1)', 'g')"

    def one_literal(value: str) -> str:
        for _ in range(3):
            value = rf"regexp_replace({value}, '(\x22\x22)({space}*)b?\x22\x22', '\1\2', 'g')"
        return value

    delta = "length(regexp_replace(l, '[^(\\[{]', '', 'g')) - length(regexp_replace(l, '[^)\\]}]', '', 'g'))"
    return rf"""plain AS MATERIALIZED (SELECT unit_id, path, text, language,
                     replace(regexp_replace(translate(regexp_replace(text, {BREAKS}, chr(10), 'g'),
                         '{_FORMATTED}{_JOINED}', ''), '\\[^\n]', '', 'g'), '\' || chr(10), '{_JOINED}') AS src
              FROM units WHERE contains(text, '+')),
lexed AS (SELECT unit_id, path, text, language,
                 regexp_extract_all(src, '{lexeme}') AS hits, string_split_regex(src, '{lexeme}') AS gaps FROM plain),
coded AS (SELECT unit_id, path, text, language, array_to_string(list_transform(range(1, len(gaps) + 1),
                 lambda k: gaps[k] || coalesce(list_transform(hits, lambda h: {stands})[k], '')), '') AS code FROM lexed),
single AS (SELECT unit_id, path, text, language, unnest(string_split(code, chr(10))) AS l,
                  unnest(range(1, len(string_split(code, chr(10))) + 1)) AS n FROM coded),
deep AS (SELECT *, sum({delta}) OVER (PARTITION BY unit_id, path ORDER BY n) AS depth,
                n + coalesce(sum({lines_in('l')}) OVER (PARTITION BY unit_id, path ORDER BY n
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM single),
told AS (SELECT *, min(depth) OVER w >= 0 AND last_value(depth) OVER w = 0 AS balanced FROM deep
         WINDOW w AS (PARTITION BY unit_id, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
headed AS (SELECT *, NOT balanced OR coalesce(lag(depth) OVER (PARTITION BY unit_id, path ORDER BY n), 0) = 0 AS starts
           FROM told),
logical AS (SELECT unit_id, path, text, language, min(line) AS line, string_agg(l, '{_JOINED}' ORDER BY n) AS l FROM (
                SELECT *, sum(starts::INTEGER) OVER (PARTITION BY unit_id, path ORDER BY n) AS part FROM headed)
            GROUP BY unit_id, path, text, language, part),
summed AS (SELECT unit_id, path, text, language, line, string_split({inner_bare(one_literal("l"))}, '+') AS parts
         FROM logical WHERE contains(l, '+')),
each_sign AS (SELECT *, unnest(range(1, len(parts))) AS i FROM summed),
words AS (SELECT unit_id, path, text, language, line, i, parts,
                 {bare_head(f"rtrim(parts[i], {blank})")} AS head, {bare_tail(f"ltrim(parts[i + 1], {blank})")} AS tail
          FROM each_sign),
sided AS (SELECT *, regexp_extract(head, '({word})$') AS left_word,
                 regexp_extract(tail, '^({word})') AS right_word FROM words),
around AS (SELECT *, left(head, length(head) - length(left_word)) AS lead,
                  rtrim(left(head, length(head) - length(left_word)), {blank}) AS before,
                  substr(tail, length(right_word) + 1) AS behind FROM sided),
operands AS (SELECT unit_id, path, text, language,
                    line + {lines_in("array_to_string(parts[1:i - 1], '') || lead")} AS line, {kind('left')}, {kind('right')}
             FROM around WHERE left_word <> '' AND right_word <> ''
               AND (before = '' AND i = 1 OR regexp_matches(before, '{opens}'))
               AND NOT regexp_matches(behind, '^[\x22\x27(\[A-Za-z0-9_.]|^{space}*[*/%@(\[\x22{_FORMATTED}]'))"""


def _sums_cte(rules: Sequence[Rule], attributes: bool, literals: Sequence[str]) -> str:
    concat = [(n, r) for n, r in enumerate(rules) if r.kind == "concat"]
    if not concat:
        empty = "SELECT rule_no, unit_id, path, text, line FROM matches WHERE false"
        return f"sums AS ({empty}),"
    number, rule = concat[0]
    names = ", ".join(text(n) for n in TAINTED_NAMES)
    prompts = ", ".join(text(n) for n in PROMPT_NAMES)
    kinds = "'name', 'attribute'" if attributes else "'name'"
    fixed = ", ".join(text(k) for k in literals)

    def tainted(s: str) -> str:
        return f"({s}_kind IN ({kinds}) AND \"{s}\" IN ({names}))"

    def prompt(s: str) -> str:
        return f"(({s}_kind = 'name' AND \"{s}\" IN ({prompts})) OR {s}_kind IN ({fixed}))"

    languages = ", ".join(text(x) for x in rule.languages)
    return f"""{operands_cte()},
sums AS (SELECT DISTINCT {number} AS rule_no, unit_id, path, text, line::INTEGER AS line FROM operands
         WHERE language IN ({languages})
           AND ({tainted('left')} AND {prompt('right')} OR {tainted('right')} AND {prompt('left')})),"""
