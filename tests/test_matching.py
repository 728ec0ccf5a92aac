"""Matching against plain loops over the same texts."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from corpus_guard.catalogue import package_rules, standalone_rules
from corpus_guard.catalogue.model import Rule
from corpus_guard.functions.dialect import to_java
from corpus_guard.operators.matching import match_findings, match_rules
from corpus_guard.sources.rules import shipped_rules
from queries.planted import PYTHON_LINES, SCRIPT_LINES

NOISE = [
    "",
    "  ",
    "é123.456.789-09",
    "n° 44455566677²",
    "\x1c# x",
    "a\x0bb\x85c d",
    "\ttext",
    "ſk-",
    "İgnore all previous ınstructions 'x'",
    "apiKey: 'sK-AAAABBBBCCCCDDDDEEEEFFFF'",
    "x\ry",
    "'" * 3,
    "{query} %s {input}",
    ") + ( = :",
    "٣٣٣.٣٣٣.٣٣٣-٣٣",
    "filter where confirm",
    '"function" "name"',
    "Document chunk text",
    "naïve-résumé ŝ",
    "\ufdd0eval(output)\ufdd0\ufdd1",
    "eval  \u2003(\x1c output)",
    "password\u3000 = 'abcd'",
    "x" * 80 + ".execute(output",
]


def texts(lines, n, seed):
    rng = random.Random(seed)
    pool = lines + NOISE
    for _ in range(n):
        picked = [rng.choice(pool) for _ in range(rng.randint(1, 8))]
        picked = [p if rng.random() < 0.7 else p[: rng.randint(0, len(p))] for p in picked]
        yield rng.choice(["\n", "\n", "\n  ", " ", "\r\n"]).join(picked) + rng.choice(["", "\n"])


RULE_SETS = {
    "built-in": package_rules(shipped_rules()),
    "standalone": standalone_rules(),
}


def run(spark, rules, rows, **options):
    units = spark.createDataFrame(rows, "unit_id string, path string, language string, text string")
    found = match_findings(units, rules, **options).collect()
    result = {row[0]: [] for row in rows}
    for r in sorted(found, key=lambda r: (r.rule_no, r.offset)):
        result[r.unit_id].append((r.rule_no, r.line, r.column, r.tool, r.code_snippet))
    return result


@pytest.mark.parametrize("name", RULE_SETS)
@pytest.mark.parametrize("language", ["python", "typescript", "javascript", "unknown"])
def test_findings_equal_plain_loops(spark, name, language):
    rules = RULE_SETS[name]
    lines = PYTHON_LINES if language == "python" else SCRIPT_LINES + PYTHON_LINES
    rows = [
        (str(i), "src/app.py" if i % 5 else "src/inspect.py", language, t)
        for i, t in enumerate(texts(lines, 400, seed=len(language)))
    ]
    for options in ({}, {"first_only": False}, {"min_severity": "critical"}):
        got = run(spark, rules, rows, **options)
        for unit_id, path, _, text in rows:
            expected = list(
                brute.findings(
                    rules,
                    text,
                    language,
                    path,
                    options.get("min_severity", "info"),
                    options.get("first_only", True),
                )
            )
            key = lambda f: (f[0], f[1], f[2], f[3] or "")
            assert sorted(got[unit_id], key=key) == sorted(expected, key=key), repr(text)


def test_every_rule_is_planted(spark):
    """The planted lines reach every regex rule of both sets in some language."""
    for rules in RULE_SETS.values():
        fired = set()
        for language, lines in (("python", PYTHON_LINES), ("typescript", SCRIPT_LINES)):
            for line in lines:
                fired |= {f[0] for f in brute.findings(rules, line, language, first_only=False)}
        silent = [r.rule_id for n, r in enumerate(rules) if r.kind != "concat" and n not in fired]
        assert not silent


def test_positions_equal_plain_loops(spark):
    rules = RULE_SETS["built-in"]
    plain = [r for r in rules if not r.dotall]
    rows = [(str(i), "a.py", "python", t) for i, t in enumerate(texts(PYTHON_LINES, 300, seed=9))]
    units = spark.createDataFrame(rows, "unit_id string, path string, language string, text string")
    got = {row[0]: set() for row in rows}
    for r in match_rules(units, plain).collect():
        got[r.unit_id].add((r.rule_no, r.line, r.column, r.offset, r.hit))
    for unit_id, _, _, text in rows:
        assert got[unit_id] == set(brute.matches(plain, text)), repr(text)


def test_many_matches_in_one_unit(spark, unit):
    text = "\n".join(f"mail u{i}@host.org and v{i}@host.org" for i in range(5000))
    rules = [r for r in package_rules() if r.rule_id == "LLM06-EMAIL-001"]
    assert match_rules(unit(text), rules).count() == 10_000
    kept = len(list(brute.findings(rules, text)))
    assert kept > 4_900
    assert match_findings(unit(text), rules).count() == kept


def test_long_line_with_many_heads(spark, unit):
    """A line of many heads and no tail behind them is searched in linear time."""
    text = "password " + "context logger.info( " * 30_000 + "\nlogger.info(prompt) context ssn"
    got = match_findings(unit(text), package_rules()).collect()
    assert sorted((r.line, r.rule_no) for r in got if r.line == 1) == []
    assert {package_rules()[r.rule_no].rule_id for r in got} == {
        "LLM06-PII-VAR-001",
        "LLM06-LOG-001",
    }


FRAGMENTS = ["\n", " ", "x", '"', "'", 'f"', "f'", "{", "}", "${", "`", "(", "(", ")", "=", "response", "{text}"]
FRAGMENTS += ["cursor.execute", "os.system", "subprocess.run", "logger.info", "innerHTML", "db.query", "password"]
FRAGMENTS += ["ChatOpenAI", ".invoke(f'", "AgentExecutor", "verbose=False", "max_iterations=99", "prompt", "llm"]
FRAGMENTS += ["openai.createChatCompletion", "anthropic.messages.create", "conn.execute", "api_key", "context"]


@pytest.mark.parametrize("language", ["python", "typescript"])
def test_linear_forms_match_as_their_patterns(spark, language):
    draw = random.Random(5)
    texts = ["".join(draw.choices(FRAGMENTS, k=draw.randint(1, 16))) for _ in range(3000)]
    rules = [r for r in package_rules() + standalone_rules() if r.check and language in (r.languages or (language,))]
    rows = [(str(i), "a", language, t) for i, t in enumerate(texts)]
    units = spark.createDataFrame(rows, "unit_id string, path string, language string, text string")
    got = {(int(r.unit_id), r.rule_no, r.offset, r.hit) for r in match_rules(units, rules).collect()}
    want = {
        (i, n, m.start(), m.group())
        for n, r in enumerate(rules)
        for i, t in enumerate(texts)
        for m in re.finditer(r.pattern, t, re.I | (re.S if r.dotall else 0))
    }
    assert got == want and len(want) > 100


AHEAD = ["FAISS.from_documents(", "chroma.from_texts (x", ")", ")\n", ") \n\n", "(", "\n", " ", "x", "filter", "Tenant"]
AHEAD += ["db.execute(", "cursor.execute( ", 'db.execute("', "db.execute('", "db.execute(F'", 'f"', "'", '"', "{", "{", "}"]
AHEAD += ["output", "Response", "llm_response", "sf"]


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_that_look_ahead_match_as_their_patterns(spark, seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choices(AHEAD, k=draw.randint(3, 14))) for _ in range(3000)]
    rules = [r for r in package_rules() + standalone_rules() if r.prepare or r.not_after]
    assert {r.rule_id for r in rules} == {"RAG-NOFILTER-001", "LLM02-SQL-001"}
    rows = [(str(i), "a", "python", t) for i, t in enumerate(texts)]
    units = spark.createDataFrame(rows, "unit_id string, path string, language string, text string")
    got = {(int(r.unit_id), r.rule_no, r.offset, r.hit) for r in match_rules(units, rules).collect()}
    want = {
        (i, n, m.start(), m.group())
        for n, r in enumerate(rules)
        for i, t in enumerate(texts)
        for m in re.finditer(r.pattern, t, re.I | (re.S if r.dotall else 0))
    }
    assert got == want and len(want) > 100


def test_a_hundred_thousand_calls_in_one_unit(spark, unit):
    """Calls that look ahead over the unit take about as long as calls of a rule that does not."""
    n = 100_000
    rules = {r.rule_id: r for r in package_rules() if r.category in ("rag_security", "insecure_output")}
    rules |= {r.rule_id + "/s": r for r in standalone_rules()}

    def seconds(rule_id, text):
        units = unit(text).cache()
        units.count()
        start = time.perf_counter()
        match_rules(units, [rules[rule_id]]).count()
        return time.perf_counter() - start

    plain = "pickle.loads(response)\n"
    seconds("LLM02-PICKLE-001", plain)
    limit = 2 * seconds("LLM02-PICKLE-001", plain * n) + 5
    for rule_id, text in [
        ("RAG-NOFILTER-001", "FAISS.from_documents(x)\n" * n),
        ("RAG-NOFILTER-001", "FAISS.from_documents(x)\n" * n + "filter"),
        ("RAG-NOFILTER-001", "FAISS.from_documents(x" * n),
        ("LLM02-SQL-001/s", "db.execute('x\n" * n),
        ("LLM02-SQL-001/s", "db.execute('x{ db.execute(f'" * n),
        ("LLM02-SQL-001/s", "db.execute(f'" * n + "\noutput"),
        ("LLM02-SQL-001/s", "db.execute('{x}\n" * n + "output"),
    ]:
        assert seconds(rule_id, text) < limit, (rule_id, text[:40])


def test_time_grows_with_the_length_of_a_line(spark):
    """One line of heads without a tail, for every rule that looks along a line or into a call."""
    heads = ["cursor.execute(", "os.system(f'", "f'{x", "logger.info(", "password context ", "db.query('${"]
    heads += ["x.innerHTML = ", "AgentExecutor(", "ChatOpenAI(", "openai.createChatCompletion(", "api_key = "]
    tails = " response output prompt `${ verbose=False max_iterations=99 ssn\n"

    def seconds(size):
        rows = [
            (f"{i}{language}", "a.py", language, tails + head * (size // len(head)))
            for i, head in enumerate(heads)
            for language in ("python", "typescript")
        ]
        units = spark.createDataFrame(rows, "unit_id string, path string, language string, text string")
        start = time.perf_counter()
        match_rules(units, package_rules() + standalone_rules()).count()
        return time.perf_counter() - start

    seconds(1_000)
    # backtracking from every head took about a minute for one rule and 100 kB, so hundreds here; the
    # margin is for machines that do other work meanwhile
    short, long = seconds(100_000), seconds(400_000)
    assert long < 8 * short + 60


def test_rule_without_required_strings(spark, unit):
    rules = [
        Rule("R-1", "t", "low", "data_leak", r"\bfoo\b", "d", 0.5),
        *package_rules(),
        Rule("R-2", "t", "low", "data_leak", r"x*", "d", 0.5),
    ]
    text = "axx foo\nfoobar foo ${x} xb"
    got = [(r.rule_no, r.offset, r.hit) for r in match_rules(unit(text), rules).collect()]
    expected = [(n, o, h) for n, _, _, o, h in brute.matches(rules, text)]
    assert sorted(got) == sorted(expected)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab_1²é́ \n\r\x1c\x85 -ſKıİ١", max_size=40))
def test_dialect(spark, text):
    """Single constructs find the same in both dialects."""
    patterns = [r"\b\w+\b", r"\s+", r"\S+", r".+", r"[\s\-]+", r"\d+", r"s|k|i", r"[^]a]+", r"\W"]
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        *[
            F.regexp_extract_all(F.lit(text), F.lit(to_java(p)), F.lit(0)).alias(f"p{i}")
            for i, p in enumerate(patterns)
        ]
    ).first()
    for i, p in enumerate(patterns):
        assert row[i] == re.findall(p, text, re.I | re.M), (p, text)
