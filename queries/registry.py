"""Every registered query with its SQL counterpart (None where SQL cannot say it)."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_guard.catalogue import package_rules, standalone_rules
from corpus_guard.catalogue import names
from corpus_guard.functions import remediate
from corpus_guard.operators import concat, findings as fo, judge, retrieval, rule_index, summary
from corpus_guard.operators.matching import match_findings, match_rules
from corpus_guard.plans.scan import ScanConfig, candidates, scan, scan_standalone, settle
from corpus_guard.plans.stage import stored
from corpus_guard.sources import files, ignore, paths, rules as rule_source, sinks, tables
from queries import corpora, oracle
from queries.oracle import findings_cte, matches_cte, rank, text

Query = Callable[[SparkSession, str], DataFrame]

CONFIG = ScanConfig()
PACKAGE = package_rules(rule_source.shipped_rules())
STANDALONE = standalone_rules()

_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        _QUERIES[name] = (query, sql)
        return query

    return keep


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}


# ------------------------------------------------------------------ raw matches
POSITIONS = ["unit_id", "path", "rule_id", "line", "column", "offset", "hit"]


def _register_matches(name: str, rule_ids: set[str] | None, units: Query, sql_units: str) -> None:
    rules = [r for r in PACKAGE if rule_ids is None or r.rule_id in rule_ids]
    rules = [r for r in rules if not r.dotall]  # of those only the start of a match is kept
    wanted = ", ".join(f'"{c}"' for c in POSITIONS)
    sql = (
        f"{matches_cte(rules, sql_units)}, rules AS (SELECT * FROM {oracle.rules_values(rules)}) "
        f"SELECT {wanted} FROM matches JOIN rules USING (rule_no)"
    )

    @register(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = match_rules(units(spark, sf_dir), rules)
        return fo.attach_rules(found, rules, ("rule_id",)).select(*POSITIONS)


_register_matches("match_card_numbers", {"LLM06-CC-001"}, corpora.raw_documents, corpora.RAW_DOCUMENTS)
_register_matches("match_emails", {"LLM06-EMAIL-001"}, corpora.raw_documents, corpora.RAW_DOCUMENTS)
_register_matches(
    "match_person_numbers",
    {"LLM06-CPF-001", "LLM06-CNPJ-001", "LLM06-SSN-001"},
    corpora.raw_documents,
    corpora.RAW_DOCUMENTS,
)
_register_matches("match_pages", None, corpora.raw_pages, corpora.RAW_PAGES)
_register_matches("match_python", None, corpora.python_units, corpora.PYTHON_UNITS)
_register_matches("match_script", None, corpora.script_units, corpora.SCRIPT_UNITS)


# ------------------------------------------------------------------ findings per detector
FOUND = ["unit_id", "path", "line", "column", "rule_id", "severity", "category", "confidence"]
FOUND += ["detected_by", "code_snippet"]
FOUND_SQL = ", ".join(f'"{c}"' for c in FOUND)
PACKAGE_SQL = {
    "python": findings_cte(PACKAGE, corpora.PYTHON_UNITS),
    "script": findings_cte(PACKAGE, corpora.SCRIPT_UNITS),
    "chat": findings_cte(PACKAGE, corpora.CHAT_UNITS),
    "documents": findings_cte(PACKAGE, corpora.RAW_DOCUMENTS),
    "pages": findings_cte(PACKAGE, corpora.RAW_PAGES),
}
UNITS = {
    "python": corpora.python_units,
    "script": corpora.script_units,
    "chat": corpora.chat_units,
    "documents": corpora.raw_documents,
    "pages": corpora.raw_pages,
}


def python_findings(spark: SparkSession, sf_dir: str, columns=fo.BRIEF) -> DataFrame:
    return scan(corpora.python_units(spark, sf_dir), CONFIG, columns=columns)


for _corpus, _sql in PACKAGE_SQL.items():

    @register(f"scan_{_corpus}", f"{_sql} SELECT {FOUND_SQL} FROM findings")
    def _scan_corpus(spark: SparkSession, sf_dir: str, corpus: str = _corpus) -> DataFrame:
        return scan(UNITS[corpus](spark, sf_dir), CONFIG, columns=fo.BRIEF).select(*FOUND)


def _register_detector(name: str, corpus: str, category: str) -> None:
    rules = [r for r in PACKAGE if r.category == category and r.kind != "concat"]
    units = {"python": corpora.PYTHON_UNITS, "script": corpora.SCRIPT_UNITS}[corpus]

    @register(name, f"{findings_cte(rules, units, 'info')} SELECT {FOUND_SQL} FROM findings")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = match_findings(UNITS[corpus](spark, sf_dir), rules)
        return fo.attach_rules(found, rules, fo.BRIEF).select(*FOUND)


for _category in (
    "prompt_injection",
    "data_leak",
    "insecure_output",
    "excessive_agency",
    "rag_security",
    "secret_exposure",
    "jailbreak",
):
    _register_detector(f"{_category}_python", "python", _category)
for _category in ("prompt_injection", "insecure_output", "secret_exposure"):
    _register_detector(f"{_category}_script", "script", _category)

_DECLARATIVE = rule_source.shipped_rules()


@register(
    "declarative_rules",
    f"{findings_cte(_DECLARATIVE, corpora.PYTHON_UNITS, 'info')} SELECT {FOUND_SQL} FROM findings",
)
def declarative_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rule_source.collect_rules(rule_source.read_rules(spark))
    found = match_findings(corpora.python_units(spark, sf_dir), rules)
    return fo.attach_rules(found, rules, fo.BRIEF).select(*FOUND)


USER_RULES = str(Path(__file__).parent / "user_rules")


@register(
    "user_rules",
    "SELECT doc_id::VARCHAR AS unit_id, "
    f"(len(string_split_regex(text, {oracle.BREAKS})) + 1)::INTEGER AS line, rule_id FROM documents, "
    "(VALUES ('USER-LONG'), ('USER-UPPER'), ('USER-PLAIN')) AS r(rule_id) WHERE doc_id % 5 = 0",
)
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's rules: required strings long, upper-case and absent; four rows are not run."""
    planted = "IF(doc_id % 5 = 0, concat(text, '\\n', repeat('a', 61), '(1) Foo(x)'), text)"
    rows = corpora.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{planted} AS text")
    rules = rule_source.collect_rules(rule_source.read_rules(spark, USER_RULES))
    found = scan(tables.units_from_table(rows, "doc_id", "text"), CONFIG, rules, columns=fo.BRIEF)
    return found.where(F.col("rule_id").startswith("USER-")).select("unit_id", "line", "rule_id")


_PAIRS = "[a-z]{5,} [a-z]{5,}"


def pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rules table that grows with the documents: three neighbouring words of each are a rule."""
    rest = corpora.table(spark, sf_dir, "documents").select(F.col("text").alias("rest"))
    found = ["pair1", "pair2", "pair3"]
    for pair in found:  # the first match stands where its words first do, the next one is looked for behind it
        rest = rest.withColumn(pair, F.regexp_substr("rest", F.lit(_PAIRS)))
        rest = rest.withColumn("rest", F.expr(f"substr(rest, instr(rest, {pair}) + length({pair}))"))
    pairs = rest.select(F.explode(F.array_compact(F.array(*found))).alias("pattern")).distinct()
    fixed = {"name": "pair", "category": "data_leak", "severity": "low", "file": "pairs"}
    given = {"id": F.concat(F.lit("PAIR-"), F.col("pattern")), "pattern": F.col("pattern"), "at": F.xxhash64("pattern")}
    schema = T._parse_datatype_string(rule_source.RULE_SCHEMA)
    columns = {f.name: F.lit(fixed.get(f.name)).cast(f.dataType) for f in schema} | {"file": F.lit("pairs")} | given
    return pairs.select(*[c.alias(n) for n, c in columns.items()])


@register(
    "many_rules",
    f"""WITH pairs AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_PAIRS}')[1:3]) AS pattern FROM documents),
    lines AS (SELECT doc_id::VARCHAR AS unit_id, unnest(string_split(lower(text), chr(10))) AS l,
                     unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line FROM documents)
    SELECT unit_id, line, 'PAIR-' || pattern AS rule_id, 'low' AS severity, (instr(l, pattern) - 1)::INTEGER AS "column"
    FROM lines JOIN pairs ON contains(l, pattern)""",
)
def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_index.scan_table(corpora.raw_documents(spark, sf_dir), pair_rules(spark, sf_dir))
    return found.select("unit_id", "line", "rule_id", "severity", "column")


_TOOLS = [r for r in PACKAGE if r.kind == "tool"]


@register(
    "dangerous_tools",
    f"{findings_cte(_TOOLS, corpora.PYTHON_UNITS, 'info', first_only=False)} "
    "SELECT unit_id, line, tool, severity, title, tags FROM findings",
)
def dangerous_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_findings(corpora.python_units(spark, sf_dir), _TOOLS, first_only=False)
    found = fo.attach_rules(found, _TOOLS, ("severity", "title", "tags"))
    tags = F.array_join("tags", ",").alias("tags")
    return found.select("unit_id", "line", "tool", "severity", "title", tags)


for _corpus, _units in (
    ("python", corpora.PYTHON_UNITS),
    ("script", corpora.SCRIPT_UNITS),
    ("chat", corpora.CHAT_UNITS),
):
    _cte = findings_cte(STANDALONE, _units, "info", attributes=False, literals=("string", "constant"))

    @register(f"standalone_{_corpus}", f"{_cte} SELECT {FOUND_SQL} FROM findings")
    def _standalone(spark: SparkSession, sf_dir: str, corpus: str = _corpus) -> DataFrame:
        units = UNITS[corpus](spark, sf_dir)
        return scan_standalone(units, columns=fo.BRIEF).select(*FOUND)


@register(
    "concat_operands",
    f"WITH units AS MATERIALIZED ({corpora.PYTHON_UNITS}), {oracle.operands_cte()} "
    'SELECT unit_id, line::INTEGER AS line, left_kind, "left" AS left_name, right_kind, '
    '"right" AS right_name FROM operands',
)
def concat_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = corpora.python_units(spark, sf_dir).where(F.contains("text", F.lit("+")))
    rows = units.select("unit_id", F.inline(F.expr(concat.operands("text"))))
    return rows.withColumnsRenamed({"left": "left_name", "right": "right_name"})


_CONCAT = [(n, r) for n, r in enumerate(PACKAGE) if r.kind == "concat"][0]


@register(
    "tainted_concatenation",
    f"{PACKAGE_SQL['python']} SELECT unit_id, line, code_snippet FROM findings "
    f"WHERE rule_id = '{_CONCAT[1].rule_id}'",
)
def tainted_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = corpora.python_units(spark, sf_dir)
    found = concat.concat_findings(units, *_CONCAT)
    return found.select("unit_id", "line", "code_snippet")


def _register_blocks(name: str, rules, options: dict) -> None:
    number, rule = [(n, r) for n, r in enumerate(rules) if r.kind == "concat"][0]
    cte = findings_cte(rules, corpora.BLOCK_UNITS, "info", **options)

    @register(name, f"{cte} SELECT unit_id, line, code_snippet FROM findings WHERE rule_no = {number}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        units = corpora.block_units(spark, sf_dir)
        found = concat.concat_findings(units, number, rule, **options)
        return found.select("unit_id", "line", "code_snippet")


_register_blocks("concatenation_over_lines", PACKAGE, {})
_register_blocks(
    "standalone_concatenation_over_lines", STANDALONE, {"attributes": False, "literals": ("string", "constant")}
)


@register(
    "finding_details",
    f"{PACKAGE_SQL['python']} SELECT unit_id, line, rule_id, title, owasp_id, owasp_name, owasp_url, "
    "description, description_pt, recommendation, recommendation_pt, fix_example, refs, tags "
    "FROM findings",
)
def finding_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = python_findings(spark, sf_dir, fo.DETAIL)
    owasp = [F.col(f"owasp.{f}").alias(f"owasp_{f}") for f in ("id", "name", "url")]
    texts = ["description", "description_pt", "recommendation", "recommendation_pt", "fix_example"]
    lists = [
        F.array_join("references", ",").alias("refs"),
        F.array_join("tags", ",").alias("tags"),
    ]
    return found.select("unit_id", "line", "rule_id", "title", *owasp, *texts, *lists)


# ------------------------------------------------------------------ filters, first-wins, order
_EVERY_SQL = findings_cte(PACKAGE, corpora.PYTHON_UNITS, "info", first_only=False)


def every_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings before de-duplication."""
    return candidates(corpora.python_units(spark, sf_dir), ScanConfig(min_severity="info"))


for _severity in ("critical", "high", "medium"):
    _cte = findings_cte(PACKAGE, corpora.PYTHON_UNITS, _severity)

    @register(f"min_severity_{_severity}", f"{_cte} SELECT {FOUND_SQL} FROM findings")
    def _min_severity(spark: SparkSession, sf_dir: str, least: str = _severity) -> DataFrame:
        config = ScanConfig(min_severity=least)
        units = corpora.python_units(spark, sf_dir)
        return scan(units, config, columns=fo.BRIEF).select(*FOUND)


@register(
    "all_findings",
    f'{_EVERY_SQL} SELECT unit_id, line, rule_id, severity, "offset" FROM findings',
)
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["unit_id", "line", "rule_id", "severity", "offset"]
    return every_finding(spark, sf_dir).select(*columns)


@register(
    "first_per_line_and_rule",
    f'{_EVERY_SQL} SELECT unit_id, line, rule_id, severity, "offset", code_snippet FROM findings '
    "QUALIFY row_number() OVER "
    '(PARTITION BY unit_id, path, line, rule_id ORDER BY rule_no, "offset") = 1',
)
def first_per_line_and_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fo.first_findings(every_finding(spark, sf_dir))
    return first.select("unit_id", "line", "rule_id", "severity", "offset", "code_snippet")


_REPORT_ORDER = f'{rank()} DESC, path, line, unit_id, rule_no, "offset"'


@register(
    "top_findings",
    f"{PACKAGE_SQL['python']} SELECT unit_id, path, line, rule_id, severity FROM findings "
    f"ORDER BY {_REPORT_ORDER} LIMIT 50",
)
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fo.top_findings(python_findings(spark, sf_dir))
    return top.select("unit_id", "path", "line", "rule_id", "severity")


@register(
    "report_order",
    f"{PACKAGE_SQL['python']} SELECT unit_id, path, line, rule_id, severity, "
    f"row_number() OVER (ORDER BY {_REPORT_ORDER}) - 1 AS place FROM findings",
)
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(fo.in_report_order(stored(python_findings(spark, sf_dir))))


def _placed(ordered: DataFrame) -> DataFrame:
    return fo.placed(ordered.select("unit_id", "path", "line", "rule_id", "severity"))


@register(
    "severity_order",
    f"{PACKAGE_SQL['python']} SELECT unit_id, path, line, rule_id, severity, row_number() OVER "
    f'(ORDER BY {rank()} DESC, path, unit_id, rule_no, line, "offset") - 1 AS place FROM findings',
)
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(fo.in_severity_order(stored(python_findings(spark, sf_dir))))


@register(
    "localized_findings",
    f"""{PACKAGE_SQL['python']} SELECT unit_id, line, rule_id,
    CASE WHEN description_pt <> '' THEN description_pt ELSE description END AS description,
    CASE WHEN recommendation_pt <> '' THEN recommendation_pt ELSE recommendation END
    AS recommendation FROM findings""",
)
def localized_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("rule_id", "description", "description_pt", "recommendation", "recommendation_pt")
    units = corpora.python_units(spark, sf_dir)
    found = fo.localized(scan(units, CONFIG, columns=(*columns, "severity")), "pt-BR")
    return found.select("unit_id", "line", "rule_id", "description", "recommendation")


# ------------------------------------------------------------------ counts
def _register_count(name: str, sql: str, count: Callable[[DataFrame], DataFrame]) -> None:
    @register(name, f"{PACKAGE_SQL['python']} {sql}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return count(python_findings(spark, sf_dir))


_FOUR = ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in summary.REPORTED
)
_register_count(
    "severity_counts", f"SELECT count(*) AS total, {_FOUR} FROM findings", summary.severity_counts
)
_register_count(
    "by_severity",
    "SELECT s.severity, count(f.severity) AS findings FROM (VALUES "
    + ", ".join(f"('{s}')" for s in names.SEVERITY_RANK)
    + ") s(severity) LEFT JOIN findings f USING (severity) GROUP BY s.severity",
    summary.by_severity,
)
_register_count(
    "counts_cube",
    "SELECT path, severity, category, level, max(findings) AS findings FROM ("
    "SELECT path, severity, category, grouping(path, severity, category) AS level, count(*) AS findings "
    "FROM findings GROUP BY CUBE (path, severity, category) UNION ALL "
    "SELECT NULL, s.severity, c.category, CASE WHEN c.category IS NULL THEN 5 ELSE 4 END, 0 FROM (VALUES "
    + ", ".join(f"('{s}')" for s in names.SEVERITY_RANK)
    + ") s(severity), (SELECT DISTINCT category FROM findings UNION ALL SELECT NULL) c) GROUP BY ALL",
    summary.counts_cube,
)
_register_count(
    "by_category",
    "SELECT category, count(*) AS findings FROM findings GROUP BY category",
    summary.by_category,
)
_register_count(
    "by_path", "SELECT path, count(*) AS findings FROM findings GROUP BY path", summary.by_path
)
_register_count(
    "path_severity_table",
    f"SELECT path, {_FOUR}, count(*) AS total FROM findings GROUP BY path",
    summary.path_severity_table,
)
_register_count(
    "category_histogram",
    "SELECT category, CASE category "
    + " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in names.CATEGORY_LABELS.items())
    + " ELSE category END AS label, count(*) AS findings FROM findings GROUP BY category",
    summary.category_histogram,
)
_register_count(
    "severity_bars",
    "SELECT severity, count(*) AS findings, repeat('█', least(count(*), 20)) AS bar FROM findings "
    "WHERE severity <> 'info' GROUP BY severity",
    summary.severity_bars,
)
_register_count(
    "worst_severity",
    f"SELECT arg_max(severity, {rank()}) AS worst FROM findings",
    summary.worst_severity,
)
_register_count(
    "severity_gate",
    f"SELECT coalesce(bool_or({rank()} >= 3), false) AS failed FROM findings",
    lambda found: summary.severity_gate(found, "high"),
)
_register_count(
    "findings_not_shown",
    "SELECT greatest(count(*) - 50, 0) AS not_shown FROM findings",
    lambda found: summary.remainder(found, 50),
)
_register_count(
    "severity_sections",
    "SELECT unit_id, line, rule_id, severity, "
    "count(*) OVER (PARTITION BY severity) AS section_findings FROM findings "
    "WHERE severity <> 'info'",
    lambda found: summary.severity_sections(stored(found)).select(
        "unit_id", "line", "rule_id", "severity", "section_findings"
    ),
)


@register(
    "unit_counts",
    f"WITH paths AS ({corpora.FILE_PATHS}) SELECT (SELECT count(*) FROM ({corpora.PYTHON_UNITS})) "
    "AS scanned_files, count(*) AS total_files_discovered FROM paths",
)
def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = corpora.file_paths(spark, sf_dir)
    return summary.unit_counts(corpora.python_units(spark, sf_dir), listed)


@register(
    "scan_summary",
    f"{PACKAGE_SQL['python']} SELECT 'documents' AS target, (SELECT count(*) FROM units) "
    f"AS scanned_files, count(*) AS total, {_FOUR} FROM findings",
)
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = corpora.python_units(spark, sf_dir)
    found = scan(units, CONFIG, columns=fo.BRIEF)
    return summary.scan_summary(found, units, {"target": "documents"})


# ------------------------------------------------------------------ verdicts
# Answers as a model might give them, by document, line and rule: findings of one unit differ.
_ANSWERS = [
    '{"verdict": "false_positive", "confidence": 0.95, "reasoning": "r"}',
    '{"verdict": "false_positive", "confidence": 0.5}',
    '{"verdict": "true_positive", "confidence": 0.8}',
    '{"verdict": "true_positive"}',
    "{oops",
    '{"verdict": null, "confidence": 0.3}',
    '{"verdict": "false_positive", "confidence": "high"}',
]
_ANSWER_NO = f"(CAST(unit_id AS BIGINT) + line + rule_no) % {len(_ANSWERS) + 1}"
_ANSWER = (
    f"CASE {_ANSWER_NO} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ANSWERS)) + " END"
)


@register(
    "judge_requests",
    f"{PACKAGE_SQL['python']} SELECT unit_id, rule_id, pattern_no, line, \"offset\", "
    + "replace(replace(replace(replace(replace("
    + text(names.JUDGE_PROMPT)
    + ", '{rule_id}', rule_id), '{title}', title), '{severity}', severity), "
    + "'{description}', description), '{code_snippet}', CASE WHEN code_snippet = '' THEN "
    + f"{text(names.EMPTY_SNIPPET)} ELSE code_snippet END) AS prompt FROM findings "
    + f"WHERE {rank()} >= 2",
)
def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (*fo.BRIEF, "title", "description")
    return judge.judge_requests(python_findings(spark, sf_dir, columns))


_JUDGED_SQL = f"""{findings_cte(PACKAGE, corpora.PYTHON_UNITS, 'low', first_only=False)},
answered AS (SELECT *, CASE {_ANSWER_NO} WHEN 0 THEN 'false_positive'
        WHEN 1 THEN 'false_positive' WHEN 2 THEN 'true_positive' WHEN 5 THEN 'null' END AS verdict,
        CASE {_ANSWER_NO} WHEN 0 THEN 0.95 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 WHEN 5 THEN 0.3
        END::DOUBLE AS sure FROM findings),
applied AS (SELECT * REPLACE (
        CASE WHEN verdict IS NOT NULL AND {rank()} >= 2
             THEN least(0.99, confidence * (0.5 + sure * 0.5)) ELSE confidence END AS confidence,
        CASE WHEN verdict IS NOT NULL AND {rank()} >= 2
             THEN detected_by || '+llm_judge' ELSE detected_by END AS detected_by)
    FROM answered
    WHERE NOT coalesce({rank()} >= 2 AND verdict = 'false_positive' AND sure >= 0.8, false))
SELECT unit_id, line, rule_id, round(confidence, 9)::DOUBLE AS confidence, detected_by
FROM applied
QUALIFY row_number() OVER (PARTITION BY unit_id, path, line, rule_id
                           ORDER BY rule_no, "offset") = 1"""


@register("judged_findings", _JUDGED_SQL)
def judged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(candidates(corpora.python_units(spark, sf_dir), CONFIG))
    answers = found.select(*judge.FINDING_KEY, F.expr(_ANSWER).alias("response"))
    judged = settle(found, judge.parse_verdicts(answers), columns=fo.BRIEF)
    confidence = F.round("confidence", 9).alias("confidence")
    return judged.select("unit_id", "line", "rule_id", confidence, "detected_by")


# ------------------------------------------------------------------ report rows
@register(
    "findings_as_json",
    f"{PACKAGE_SQL['python']} SELECT to_json({{'rule_id': rule_id, 'title': title, "
    "'severity': severity, 'path': path, 'line': line, 'code_snippet': code_snippet, "
    "'tool': tool})::VARCHAR "
    "AS json FROM findings",
)
def findings_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = python_findings(spark, sf_dir, ("rule_id", "title", "severity"))
    fields = ("rule_id", "title", "severity", "path", "line", "code_snippet", "tool")
    return sinks.as_json(found.select(*fields))


@register(
    "report_rows",
    f"{PACKAGE_SQL['python']} SELECT rule_id, severity, path AS file_path, line, "
    "0.1::DOUBLE AS false_positive_likelihood, owasp_id, tool, row_number() OVER "
    f"(ORDER BY {_REPORT_ORDER}) - 1 AS place FROM findings",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(python_findings(spark, sf_dir, ("rule_id", "severity", "owasp")))
    rows = sinks.report_rows(found.withColumn("label", F.col("tool")))
    rows = rows.select(
        "rule_id",
        "severity",
        "file_path",
        "line",
        F.col("false_positive_likelihood").cast("double").alias("false_positive_likelihood"),
        F.col("owasp.id").alias("owasp_id"),
        F.col("label").alias("tool"),
    )
    return fo.placed(rows)


@register(
    "report_summary",
    f"{PACKAGE_SQL['python']} SELECT 'corpus-guard' AS tool, '0.1.0' AS version, 'documents' AS "
    "target, '2024-05-06T07:08:09Z' AS scanned_at, '2024-05-06 07:08 UTC' AS scanned_at_label, "
    f"(SELECT count(*) FROM units) AS scanned_files, count(*) AS total, {_FOUR} FROM findings",
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = corpora.python_units(spark, sf_dir)
    meta = {k: sinks.META[k] for k in ("tool", "version")}
    meta |= {"target": "documents", "scanned_at": "2024-05-06T07:08:09Z"}
    return sinks.summary_row(scan(units, CONFIG, columns=fo.BRIEF), units, meta)


@register(
    "event_time_labels",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M UTC') AS label FROM events",
)
def event_time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpora.table(spark, sf_dir, "events")
    return events.select("event_id", sinks.timestamp_label(F.col("ts")).alias("label"))


@register(
    "standalone_report_rows",
    f"{findings_cte(STANDALONE, corpora.PYTHON_UNITS, 'info', attributes=False, literals=('string', 'constant'))} "
    "SELECT rule_id, title, severity, category, owasp_id, path AS file, line, description, "
    "recommendation, confidence, code_snippet FROM findings",
)
def standalone_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = corpora.python_units(spark, sf_dir)
    return sinks.standalone_report_rows(stored(scan_standalone(units)))


@register(
    "listed_findings",
    f"{PACKAGE_SQL['python']} SELECT unit_id, line, rule_id, "
    "round_even(confidence::DOUBLE * 100, 0)::INTEGER || '%' AS confidence, "
    "left(recommendation, 200) AS fix FROM findings",
)
def listed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = python_findings(spark, sf_dir, ("rule_id", "severity", "confidence", "recommendation"))
    return found.select(
        "unit_id",
        "line",
        "rule_id",
        sinks.percent(F.col("confidence")).alias("confidence"),
        sinks.recommendation_excerpt(F.col("recommendation")).alias("fix"),
    )


_LISTED = ", ".join(
    f"({text(r.rule_id)}, {text(r.title)}, {text(r.category)}, {text(r.severity)}, "
    f"{text(r.languages[0] if r.languages else 'any')})"
    for r in _DECLARATIVE
)


@register(
    "rule_listing",
    f"{PACKAGE_SQL['python']} SELECT l.*, count(f.rule_id) AS findings FROM (VALUES {_LISTED}) "
    "l(id, name, category, severity, language) LEFT JOIN findings f ON f.rule_id = l.id "
    "GROUP BY ALL",
)
def rule_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = python_findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))
    listed = rule_source.rule_listing(rule_source.read_rules(spark), "prompt_injection")
    # one row per rule id on the counted side
    joined = listed.join(F.broadcast(counted), listed.id == counted.rule_id, "left")
    return joined.select(
        "id", "name", "category", "severity", "language", F.coalesce("n", F.lit(0)).alias("findings")
    )


# ------------------------------------------------------------------ paths and files
_PATHS = f"WITH paths AS ({corpora.FILE_PATHS})"
_SUFFIX = r"lower(regexp_extract(path, '[^/]+(\.[^./]+)$', 1))"


def _language_sql(table: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in table.items())
    return f"CASE {_SUFFIX} {cases} ELSE {default} END"


_LANGUAGE = _language_sql(names.EXTENSION_LANGUAGE, "'unknown'")
_STANDALONE_LANGUAGE = _language_sql(names.STANDALONE_EXTENSION_LANGUAGE, "NULL")


@register(
    "path_languages",
    f"{_PATHS} SELECT doc_id, path, {_LANGUAGE} AS language, "
    f"{_STANDALONE_LANGUAGE} AS standalone_language FROM paths",
)
def path_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return corpora.file_paths(spark, sf_dir).select(
        "doc_id",
        "path",
        paths.language_of(path).alias("language"),
        paths.standalone_language_of(path).alias("standalone_language"),
    )


@register(
    "source_files",
    f"{_PATHS} SELECT doc_id, path FROM paths WHERE {_LANGUAGE} IN ('python', 'typescript') "
    "AND size_bytes <= 4000",
)
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = paths.has_language(F.col("path"), ["python", "typescript"])
    small = paths.within_size(F.col("size_bytes"), 4000)
    return corpora.file_paths(spark, sf_dir).where(wanted & small).select("doc_id", "path")


# The default patterns spelled out: directories, endings, file names.
_IGNORED_SQL = (
    r"regexp_matches(path, '(^|/)(__pycache__|\.git|\.hg|\.svn|node_modules|\.venv|venv|env|\.env|"
    r"dist|build|[^/]*\.egg-info|\.tox|\.mypy_cache|\.ruff_cache|\.pytest_cache)/') OR "
    r"regexp_matches(path, '(\.pyc|\.pyo|\.min\.js|\.bundle\.js|\.lock)(/|$)') OR "
    r"regexp_matches(path, '(^|/)package-lock\.json(/|$)')"
)


@register("ignored_paths", f"{_PATHS} SELECT doc_id, path, {_IGNORED_SQL} AS ignored FROM paths")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignored = ignore.ignored(F.col("path")).alias("ignored")
    return corpora.file_paths(spark, sf_dir).select("doc_id", "path", ignored)


# Own patterns follow the default ones. The last match decides for a file, but a directory that is
# left out is not entered.
_OWN_PATTERNS = ["*.js", "!f1*.js", "/src/*/f2*"]


@register(
    "ignored_paths_with_own_patterns",
    f"{_PATHS}, split AS (SELECT doc_id, path, regexp_extract(path, '^.*/') AS dirs FROM paths) "
    r"SELECT doc_id, path, regexp_matches(dirs, '(^|/)(__pycache__|\.git|node_modules|venv|build|"
    r"dist|[^/]*\.egg-info)/') OR CASE WHEN regexp_matches(path, '^src/[^/]*/f2') THEN true "
    r"WHEN regexp_matches(path, '/f1[^/]*\.js$') THEN false WHEN path LIKE '%.js' THEN true "
    f"ELSE {_IGNORED_SQL} END AS ignored FROM split",
)
def ignored_paths_with_own_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [*names.DEFAULT_IGNORE_PATTERNS, *_OWN_PATTERNS]
    ignored = ignore.ignored(F.col("path"), patterns).alias("ignored")
    return corpora.file_paths(spark, sf_dir).select("doc_id", "path", ignored)


_WORDS = list(dict.fromkeys(p.rstrip("/").lstrip("*.") for p in names.DEFAULT_IGNORE_PATTERNS))


@register(
    "ignored_paths_by_substring",
    f"{_PATHS} SELECT doc_id, path, "
    + " OR ".join(f"contains(path, '{w}')" for w in _WORDS)
    + " AS ignored FROM paths",
)
def ignored_paths_by_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignored = ignore.ignored_by_substring(F.col("path")).alias("ignored")
    return corpora.file_paths(spark, sf_dir).select("doc_id", "path", ignored)


@register(
    "parsed_pattern_lines",
    "WITH lines AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), "
    "' ' || chr(9) || chr(13)) AS value FROM documents) SELECT doc_id, value, count(*) AS n "
    "FROM lines WHERE value <> '' AND NOT starts_with(value, '#') GROUP BY ALL",
)
def parsed_pattern_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpora.table(spark, sf_dir, "documents")
    lines = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    parsed = ignore.parse_ignore_lines(lines)
    return parsed.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


_DIRECTORY = r"regexp_extract(path, '^(.*)/[^/]*$', 1)"


@register(
    "nearest_ignore_file",
    f"{_PATHS}, dirs AS (SELECT DISTINCT {_DIRECTORY} AS directory FROM paths "
    "WHERE path LIKE '%.json'), unique_paths AS (SELECT DISTINCT path FROM paths) "
    "SELECT path, directory FROM unique_paths JOIN dirs ON starts_with(path, directory || '/') "
    "QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(directory) DESC) = 1",
)
def nearest_ignore_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = corpora.file_paths(spark, sf_dir)
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory")
    directories = listed.where(F.col("path").endswith(".json")).select(directory)
    return ignore.nearest_ignore_file(listed, directories)


_FILE_LINES = ["# own patterns", "*.js", "!f1*.js", " /f2* ", ""]


@register(
    "ignored_by_files",
    f"{_PATHS}, dirs AS (SELECT DISTINCT {_DIRECTORY} AS directory FROM paths WHERE path LIKE '%.json'), "
    "placed AS (SELECT doc_id, path, directory, substr(path, length(directory) + 2) AS file "
    "FROM paths LEFT JOIN dirs ON starts_with(path, directory || '/') "
    "QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY length(directory) DESC) = 1) "
    "SELECT doc_id, path, regexp_matches(path, '(^|/)(__pycache__|\\.git|node_modules|venv|build|dist|[^/]*\\.egg-info)/') "
    "OR CASE WHEN directory IS NULL THEN ({_IGNORED_SQL}) "
    "WHEN length(directory) % 2 = 0 AND file LIKE '%.min.js' THEN false WHEN file LIKE 'f2%' THEN true "
    "WHEN regexp_matches(file, '^f1[^/]*\\.js$') THEN false WHEN file LIKE '%.js' THEN true "
    "ELSE ({_IGNORED_SQL}) END AS ignored FROM placed".replace("{_IGNORED_SQL}", _IGNORED_SQL),
)
def ignored_by_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that hold a .json have an ignore file, of one line more where their name is even."""
    listed = corpora.file_paths(spark, sf_dir)
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory")
    own = F.concat(F.lit(_FILE_LINES), F.when(F.length("directory") % 2 == 0, F.array(F.lit("!*.min.js"))).otherwise(F.array()))
    lines = listed.where(F.col("path").endswith(".json")).select(directory).distinct()
    lines = lines.select("directory", F.posexplode(own).alias("number", "line"))
    return ignore.ignored_by_files(listed, lines).select("doc_id", "path", "ignored")


_HIDDEN = r"regexp_matches(path, '(^|/)\.')"


def _in_directories(directories, whole: bool) -> str:
    checked = "string_split(path, '/')" if whole else "string_split(path, '/')[:-2]"
    listed = ", ".join(text(d) for d in directories)
    return f"list_has_any({checked}, [{listed}])"


@register(
    "standalone_walk",
    f"{_PATHS} SELECT doc_id, path FROM paths WHERE {_STANDALONE_LANGUAGE} IS NOT NULL "
    f"AND NOT {_HIDDEN} AND NOT {_in_directories(names.STANDALONE_IGNORE_DIRS, False)}",
)
def standalone_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = corpora.file_paths(spark, sf_dir)
    return listed.where(paths.standalone_walks(F.col("path"))).select("doc_id", "path")


@register(
    "standalone_file_count",
    f"{_PATHS} SELECT count(*) AS n FROM paths WHERE {_STANDALONE_LANGUAGE} IS NOT NULL "
    f"AND NOT {_in_directories(names.STANDALONE_COUNT_SKIP_DIRS, True)}",
)
def standalone_file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = corpora.file_paths(spark, sf_dir)
    return listed.where(paths.standalone_counts(F.col("path"))).agg(F.count("*").alias("n"))


@register(
    "file_inventory",
    f"{_PATHS} SELECT doc_id, path, size_bytes, CASE WHEN {_IGNORED_SQL} THEN 'ignored' "
    f"WHEN {_LANGUAGE} NOT IN ('python', 'typescript') THEN 'language' "
    "WHEN size_bytes > 4000 THEN 'size' END AS skipped FROM paths",
)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = corpora.file_paths(spark, sf_dir)
    return files.with_reason(listed, ["python", "typescript"], max_bytes=4000)


@register(
    "decoded_text",
    "SELECT doc_id, replace(text, chr(13), '') || chr(65533) || 'é' || chr(10) AS text FROM documents",
)
def decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a bad byte, an accented letter and a carriage return behind every text
    content = F.concat(F.encode("text", "UTF-8"), F.expr("X'FFC3A90D'"))
    documents = corpora.table(spark, sf_dir, "documents")
    return documents.select("doc_id", files.decode(content).alias("text"))


@register(
    "distinct_paths",
    "SELECT source AS path, min(doc_id::VARCHAR) AS unit_id FROM documents GROUP BY source",
)
def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = corpora.raw_documents(spark, sf_dir)
    return tables.distinct_units(units).select("path", "unit_id")


# ------------------------------------------------------------------ remediation and retrieval
_MASKED = "text"
for _pattern, _replacement in remediate.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, {text(_pattern)}, {text(_replacement)}, 'g')"


@register("masked_documents", f"SELECT doc_id, {_MASKED} AS text FROM documents")
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpora.table(spark, sf_dir, "documents")
    return documents.select("doc_id", remediate.mask_pii(F.col("text")).alias("text"))


@register(
    "masked_numbers",
    "SELECT c_custkey, CASE WHEN length(d) >= 2 THEN '***.***.***-' || right(d, 2) ELSE '***' END "
    "AS masked FROM (SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS d "
    "FROM customer)",
)
def masked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = corpora.table(spark, sf_dir, "customer")
    return customers.select("c_custkey", remediate.mask_cpf(F.col("c_name")).alias("masked"))


@register(
    "sanitized_prompts",
    f"WITH units AS ({corpora.CHAT_UNITS}) SELECT unit_id, trim(regexp_replace(left(text, 2000), "
    "'(?i)(ignore|forget|disregard).*(instructions|above|previous)', '', 'g'), "
    "' ' || chr(9) || chr(10) || chr(13)) AS prompt FROM units",
)
def sanitized_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = corpora.chat_units(spark, sf_dir)
    return units.select("unit_id", remediate.sanitize_prompt(F.col("text")).alias("prompt"))


@register(
    "sanitized_markup",
    "SELECT page_id, replace(replace(left(html, 2000), '<', ''), '>', '') AS prompt FROM pages",
)
def sanitized_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpora.table(spark, sf_dir, "pages")
    return pages.select("page_id", remediate.sanitize_markup(F.col("html")).alias("prompt"))


@register(
    "content_free_log",
    "SELECT conv_id, turn, role, length(text)::INTEGER AS n_chars FROM conversations",
)
def content_free_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = corpora.table(spark, sf_dir, "conversations")
    return retrieval.content_free_log(turns, ["conv_id", "turn", "role"])


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as documents of two tenants with two roles each."""
    return corpora.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.expr("concat('tenant', label % 2)").alias("tenant_id"),
        F.expr("array(concat('role', vec_id % 3), concat('role', label))").alias("allowed_roles"),
        "embedding",
    )


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = corpora.table(spark, sf_dir, "embeddings")
    query = F.lit([float(x) for x in vectors.where("vec_id = 0").first().embedding])
    return retrieval.secure_retrieve(_readable(spark, sf_dir), query, "tenant0", ["role1", "role4"], k=20)


_RETRIEVED_SQL = """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
top AS (SELECT vec_id AS doc_id,
               list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)) AS similarity
        FROM embeddings WHERE label % 2 = 0
          AND list_has_any(['role' || (vec_id % 3), 'role' || label], ['role1', 'role4'])
        ORDER BY similarity DESC, doc_id LIMIT 20)"""


@register(
    "secure_retrieval",
    f"{_RETRIEVED_SQL} SELECT doc_id, round(similarity, 6)::DOUBLE AS similarity FROM top",
)
def secure_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity = F.round("similarity", 6).alias("similarity")
    return _retrieved(spark, sf_dir).select("doc_id", similarity)


_ASKED = "SELECT vec_id AS query_id, 'tenant' || (label % 2) AS tenant_id, ['role' || (vec_id % 3), 'role4'] AS roles, embedding FROM embeddings WHERE vec_id % 50 = 0"
_ANSWERED_SQL = f"""WITH asked AS ({_ASKED}),
pairs AS (SELECT query_id, d.vec_id AS doc_id,
                 round(list_cosine_similarity(d.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS similarity
          FROM asked q JOIN embeddings d ON 'tenant' || (d.label % 2) = q.tenant_id
           AND list_has_any(['role' || (d.vec_id % 3), 'role' || d.label], q.roles)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) - 1 AS place FROM pairs
        QUALIFY place < 10)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector asks, for its tenant and two roles."""
    return corpora.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"),
        F.expr("concat('tenant', label % 2)").alias("tenant_id"),
        F.expr("array(concat('role', vec_id % 3), 'role4')").alias("roles"),
        "embedding",
    )


@register(
    "secure_retrieval_by_query",
    f"{_ANSWERED_SQL} SELECT query_id, place::INTEGER AS place, doc_id, round(similarity, 6)::DOUBLE AS similarity FROM top",
)
def secure_retrieval_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.secure_retrieve_all(_readable(spark, sf_dir), _asked(spark, sf_dir), k=10)
    return found.withColumn("similarity", F.round("similarity", 6))


@register(
    "source_counts",
    f"{_ANSWERED_SQL} SELECT query_id, count(doc_id) AS source_count FROM asked LEFT JOIN top USING (query_id) GROUP BY query_id",
)
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    return retrieval.source_counts(retrieval.secure_retrieve_all(_readable(spark, sf_dir), asked, k=10), asked)


@register("source_count", f"{_RETRIEVED_SQL} SELECT count(*) AS source_count FROM top")
def source_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.source_count(_retrieved(spark, sf_dir))
