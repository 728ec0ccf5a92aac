"""Scans with rules tables against the same rules as literals of a plan, and required strings."""

import json
import random
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_guard.functions.required import best, is_required, required
from corpus_guard.operators import rule_index
from corpus_guard.operators.findings import placed
from corpus_guard.operators.rule_index import scan_table
from corpus_guard.plans.scan import ScanConfig, scan
from corpus_guard.sources import rules as rule_source
from queries.registry import pair_rules

COLUMNS = ("rule_id", "severity", "category", "confidence", "title", "tags")
SHOWN = ["unit_id", "line", "rule_id", "severity", "column", "offset", "code_snippet", "title"]


@pytest.fixture
def rules_table(spark, tmp_path):
    def make(*rows):
        fixed = {"name": "n", "category": "jailbreak", "severity": "low"}
        lines = [json.dumps(fixed | row) for row in rows]
        (tmp_path / "rules.json").write_text("\n".join(lines), encoding="utf-8")
        return rule_source.read_rules(spark, str(tmp_path))

    return make


def rows_of(found):
    return sorted(tuple(r) for r in found.select(*SHOWN).collect())


def literal(units, table, **config):
    """The same rules in the plan; the built-in ones say nothing here."""
    found = scan(units, ScanConfig(**config), rule_source.collect_rules(table), columns=COLUMNS)
    return rows_of(found.where(F.col("rule_id").startswith("R")))


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("eval\\(", [("eval(",)]),
        ("Foo\\s*\\(bar", [("foo",), ("(bar",)]),
        ("(?:cursor|db)\\.execute", [("cursor", "db"), (".execute",)]),
        ("a+bc{2}d?e", [("a",), ("b",), ("c",), ("e",)]),
        ("x*", []),
        ("[kK]ey\\b=(?!no)v", [("key=v",)]),
        ("(?P<q>ab)(?=cd)ef", [("abef",)]),
        ("a|b*", []),
        ("é[0-9]prix", [("prix",)]),
        ("(?:ab|(?:cd|ef)g)", [("ab", "cd", "ef")]),
    ],
)
def test_required_strings(pattern, want):
    got = required(pattern)
    assert got == want or [tuple(sorted(g)) for g in got] == [tuple(sorted(g)) for g in want]


def test_required_strings_are_in_every_match():
    draw = random.Random(4)
    atoms = ["a", "b", "[ab]", "[aA]", "(?:ab|ba)", "(?:a|b+)", "a?", "b*", "(?:aab){2}", "\\s*", ".", "(bb|a.b)"]
    checked = 0
    for _ in range(300):
        pattern = "".join(draw.choice(atoms) for _ in range(draw.randint(1, 5)))
        groups = required(pattern)
        for _ in range(30):
            text = "".join(draw.choice("abAB ") for _ in range(12))
            for m in re.finditer(pattern, text, re.I):
                checked += 1
                assert all(any(w in m[0].lower() for w in g) for g in groups), (pattern, m[0])
    assert checked > 3000


def test_needs_that_a_pattern_does_not_imply(rules_table, unit):
    assert is_required(("foo(",), "foo\\s*\\(") and is_required(("Foo",), "xfooy")
    assert not is_required(("foo(",), "foo\\s*x?\\(") and not is_required(("bar",), "foo|bar")
    table = rules_table(
        {"id": "R1", "pattern": "needle", "needs": [["haystack"]]},
        {"id": "R2", "pattern": "needle", "needs": [["need", "other"], ["dle"]]},
        {"id": "R3", "pattern": "(("},
        {"id": "R4", "pattern": "x", "pattern_type": "ast"},
    )
    problems = {(r.id, r.problem) for r in rule_source.rule_problems(table).collect()}
    assert problems == {
        ("R1", "needs is not implied: haystack"),
        ("R3", "pattern does not compile"),
        ("R4", "pattern type is not run"),
    }
    units = unit("a needle here")
    assert [r[2] for r in literal(units, table)] == ["R1", "R2"]
    assert rows_of(scan_table(units, table, columns=COLUMNS)) == literal(units, table)


TEXTS = ["def f(x):\n    return Alpha(x) + beta\n", "alpha BETA gamma\nalpha beta\r\nalphabet", "", None, "ſet the K-key, İstanbul",
         "12-34 and 56-78\n90-12", "a﷐b alpha﷐", "beta\n" * 400, "Gamma\tdelta " * 50]


def test_equal_to_literal_rules(rules_table, unit, monkeypatch):
    rows = [
        {"id": "R-1", "pattern": "alpha"},
        {"id": "R-2", "pattern": "beta", "severity": "high"},
        {"id": "R-3", "pattern": "[0-9]{2}-[0-9]{2}"},
        {"id": "R-4", "pattern": "set|key|istanbul"},
        {"id": "R-1", "pattern": "alpha\\s*\\(", "severity": "critical"},
        {"id": "R-5", "pattern": "beta$"},
        {"id": "R-6", "pattern": "delta", "language": "typescript"},
        {"id": "R-7", "pattern": "a\\.b|alpha"},
        {"id": "R-8", "pattern": "gamma\\s+delta|return\\s+Alpha"},
        {"id": "R-9", "pattern": "nothing here"},
        {"id": "R-10", "pattern": "be"},
        {"id": "R-11", "pattern": "beta", "enabled": False},
        {"id": "R-12", "pattern": "beta", "category": "of no detector"},
    ]
    table, units = rules_table(*rows), unit(*TEXTS)
    want = literal(units, table)
    assert len(want) > 100 and {r[2] for r in want} >= {"R-1", "R-2", "R-3", "R-4", "R-7", "R-10"}
    assert rows_of(scan_table(units, table, columns=COLUMNS)) == want
    high = scan_table(units, table, "high", columns=COLUMNS)
    assert rows_of(high) == literal(units, table, min_severity="high") != []
    monkeypatch.setattr(rule_index, "BLOCK", 3)
    monkeypatch.setattr(rule_index, "TEXT_BYTES", 5)
    assert rows_of(scan_table(units, table, columns=COLUMNS)) == want


def word_rules(n, seed=1):
    draw = random.Random(seed)
    words = sorted({"".join(draw.choice("abcdefghij") for _ in range(draw.randint(5, 9))) for _ in range(2 * n)})[:n]
    kinds = ["{}", "{}\\s*\\(", "\\b{}\\b", "x{}|{}y", "{}[0-9]+"]
    return words, [{"id": f"R{i}", "pattern": kinds[i % 5].format(w, w)} for i, w in enumerate(words)]


def word_texts(words, n, seed=2):
    draw = random.Random(seed)
    ends = ["", "(", " (", "7", "y", "q"]
    return ["\n".join(" ".join(draw.choice(words).upper() + draw.choice(ends) for _ in range(6)) for _ in range(5)) for _ in range(n)]


def test_five_hundred_rules_equal_the_literal_plan(rules_table, unit):
    words, rows = word_rules(500)
    table, units = rules_table(*rows), unit(*word_texts(words, 30))
    want = literal(units, table)
    assert len(want) > 300 and rows_of(scan_table(units, table, columns=COLUMNS)) == want


def test_twenty_thousand_rules_have_the_plan_of_a_few(rules_table, unit):
    words, rows = word_rules(20_000)
    units = unit(*word_texts(words, 200))

    def plan(found):
        return re.sub(r"#\d+L?|\d+", "", found._jdf.queryExecution().optimizedPlan().toString())

    few = plan(scan_table(units, rules_table(*rows[:50]), columns=COLUMNS))
    found = scan_table(units, rules_table(*rows), columns=COLUMNS)
    assert abs(len(plan(found)) - len(few)) < 200
    got = rows_of(found)
    patterns = {r["id"]: re.compile(r["pattern"], re.I) for r in rows}
    want = set()
    by_word = {w: r["id"] for w, r in zip(words, rows)}
    for number, text in enumerate(r.text for r in units.orderBy(F.col("unit_id").cast("int")).collect()):
        for line, content in enumerate(text.split("\n"), 1):
            held = {i for w, i in by_word.items() if w in content.lower()}
            want |= {(str(number), line, i) for i in held if patterns[i].search(content)}
    assert {r[:3] for r in got} == want and len(got) == len(want) > 2000


def test_a_rule_is_a_candidate_only_where_its_string_is(rules_table, monkeypatch):
    monkeypatch.setattr(rule_index, "CHUNK", 200)
    monkeypatch.setattr(rule_index, "PART", 3000)
    long = "a string that is longer than the bytes that are looked up, number "
    words = [f"common part {i:03d}" for i in range(300)] + [f"{long}{i}" for i in range(3)]
    table = rules_table(*[{"id": f"R{i}", "pattern": w} for i, w in enumerate(words)])
    ready = rule_index.prepared(table)
    ids = {r.no: r.rule_id for r in ready.collect()}
    index = SimpleNamespace(value=rule_index.indexed(ready))
    texts = ["Common Part 007 and common part 1234, common part 00", None, "", "common part", " ".join(words[:40]), f"x{long.upper()}2"]
    found = {}
    for batch in rule_index._candidates(index)([pa.record_batch({"text": pa.array(texts)})]):
        for text, rules in zip(*[batch.column(c).to_pylist() for c in ("text", "__rules")]):
            found.setdefault(texts.index(text), []).extend(ids[r["no"]] for r in rules)
    # beginnings of long strings are alike
    want = {0: ["R123", "R7"], 4: sorted(f"R{i}" for i in range(40)), 5: ["R300", "R301", "R302"]}
    assert {k: sorted(v) for k, v in found.items()} == want


LITERALS = ["alpha beta", "aaaa", "eval\\(", "K-KEY", "set the", "a, b: \\[c\\]", "x" * 40, "y" * 1100, "istanbul", "beta\\ gamma", "12-34"]
ODD_TEXTS = [
    "Alpha Beta\r\nalpha beta alpha beta\x0cé ü alpha BETA\u2028end\n\nalpha beta",
    "aaaaaaaaa\naaa\naaaa aaaa",
    "😀 eval(x) é eval(y)\n\x85eval(z)\n",
    "ſet the K-Key in İstanbul\nıſtanbul",
    "A, B: [C]" * 3,
    "x" * 95 + "\n" + "X" * 40,
    "Y" * 1099 + "\n" + "y" * 1200,
    None,
    "",
    "beta gamma\n" * 30 + "12-34 12-345",
    "alpha bet",
    "a alpha beta",
]


def test_literals_equal_the_literal_plan(rules_table, unit, monkeypatch):
    rows = [{"id": f"R{i}", "pattern": p} for i, p in enumerate(LITERALS)]
    rows += [
        {"id": "R20", "pattern": "ALPHA beta", "severity": "high", "tags": ["t"], "confidence": 0.5},
        {"id": "R21", "pattern": "alpha beta", "language": "typescript"},
        {"id": "R22", "pattern": "alpha beta", "language": "python"},
        {"id": "R23", "pattern": "alpha beta"},
        {"id": "R23", "pattern": "aaaa"},
        {"id": "R24", "pattern": "aaaa", "category": "of no detector"},
        {"id": "R24", "pattern": "beta gamma"},
        {"id": "R25", "pattern": "eval.\\w"},
        {"id": "R26", "pattern": "aaaa", "pattern_type": "ast"},
    ]
    table, units = rules_table(*rows), unit(*ODD_TEXTS)
    want = literal(units, table)
    assert {r[2] for r in want} == {r["id"] for r in rows} - {"R21", "R26"}
    assert rows_of(scan_table(units, table, columns=COLUMNS)) == want
    for name, value in {"TEXT_BYTES": 7, "PART": 64, "STRINGS": 3, "STRING_BYTES": 500}.items():
        monkeypatch.setattr(rule_index, name, value)
    assert rows_of(scan_table(units, table, columns=COLUMNS)) == want
    high = scan_table(units, table, "high", columns=COLUMNS)
    assert rows_of(high) == literal(units, table, min_severity="high") != []


def test_columns_that_are_kept(rules_table, unit):
    table = rules_table({"id": "R1", "pattern": "needle"}, {"id": "R2", "pattern": "need.e"})
    keep = ["unit_id", "path", "language", "text"]
    found = scan_table(unit("a needle", "\nneedle"), table, columns=("rule_id",), keep=keep)
    got = sorted(tuple(r) for r in found.select("rule_id", *keep, "line").collect())
    texts = [("0", "app.py", "python", "a needle", 1), ("1", "app.py", "python", "\nneedle", 2)]
    assert got == [(rule, *row) for rule in ("R1", "R2") for row in texts]


def test_literals_of_any_number_take_one_pass(rules_table, unit, monkeypatch):
    monkeypatch.setattr(rule_index, "BLOCK", 3)
    words = [f"word number {i:03d}" for i in range(200)]
    table = rules_table(*[{"id": f"R{i}", "pattern": w} for i, w in enumerate(words)])
    found = scan_table(unit(*words, " ".join(words)), table, columns=COLUMNS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted(r[:3] for r in rows_of(found)) == sorted([(str(i), 1, f"R{i}") for i in range(200)] + [("200", 1, f"R{i}") for i in range(200)])


def test_literal_rules_have_the_columns_of_others(rules_table):
    given = {"owasp_id": "LLM01", "owasp_name": "n", "confidence": 0.3, "language": "python", "tags": ["a", "b"]}
    given |= {"references": ["r"], "description": "d", "recommendation_pt": "p", "fix_example": "f", "severity": "critical"}
    table = rules_table(
        {"id": "R1", "pattern": "Some \\(Text\\)"},
        {"id": "R2", "pattern": "two && 'three' # ~", **given},
        {"id": "R3", "pattern": "with \"quotes\" - <b>", "owasp_id": "LLM02", "pattern_type": "regex"},
    )
    numbered = placed(table.withColumn("literal", rule_index._literal(table)).orderBy("file", "at"), "rule_no")
    made = rule_index._literal_rules(numbered)
    rows = numbered.drop("file", "at", "literal").withColumnRenamed("rule_no", "at")
    want = rows.mapInPandas(rule_index._prepare, rule_index._PREPARED)
    assert made.drop("literal").dtypes == want.dtypes
    got = sorted(made.drop("literal").collect(), key=lambda r: r.rule_id)
    assert got == sorted(want.collect(), key=lambda r: r.rule_id) and len(got) == 3
    assert [r.literal for r in made.orderBy("at").collect()] == ["some (text)", "two && 'three' # ~", 'with "quotes" - <b>']


@pytest.mark.parametrize("pattern", ["ab.cd", "abcd+", "ab[c]d", "abc", "^abcd", "abcd$", "ab|cd", "\\babcd", "abéd", "ab\ncd", "ab{2}cd", "(abcd)", "abcd\\"])
def test_patterns_that_are_no_literals(rules_table, pattern):
    table = rules_table({"id": "R1", "pattern": pattern})
    assert [r[0] for r in table.select(rule_index._literal(table)).collect()] == [None]


def test_places_of_random_strings():
    draw = random.Random(8)
    for longest in (6, 12, 40):
        words = {"".join(draw.choice("ab ") for _ in range(draw.randint(4, longest))) for _ in range(40)}
        texts = ["".join(draw.choice("abAB ") for _ in range(draw.randint(0, 60))) for _ in range(40)]
        texts += [w.upper() + w for w in words]
        table = rule_index.Literals(pa.array(sorted(words)))
        table.block = 16
        data, offsets = rule_index._folded(pa.array(texts))
        got = {(int(p), int(n)) for places, sizes in table.places(data, offsets) for p, n in zip(places, sizes)}
        want = set()
        for text, at in zip(texts, offsets):
            low = text.lower()
            want |= {(int(at) + i, len(w)) for w in words for i in range(len(low)) if low.startswith(w, i)}
        assert want <= got and len(got) < 1.1 * len(want) + 5


def test_pair_rules_are_the_first_three_pairs_of_words(spark, tmp_path):
    draw = random.Random(5)
    texts = [None, "", "hello world", "one two", "a hello  world\nagain there xhello worldly Hello there", "über hello world 😀 hello world hello world other words"]
    texts += ["".join(draw.choice("abcé  \nB") for _ in range(200)) for _ in range(30)]
    texts += [" ".join("".join(draw.choices("abc", k=draw.randint(2, 8))) for _ in range(30)) for _ in range(30)]
    texts += [" ".join("ab" * draw.randint(1, 4) for _ in range(30)) for _ in range(10)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    want = {p for t in texts if t for p in re.findall("[a-z]{5,} [a-z]{5,}", t)[:3]}
    got = [r.pattern for r in pair_rules(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_no_rules_and_no_units(rules_table, unit):
    table = rules_table({"id": "R1", "pattern": "needle"})
    assert scan_table(unit("needle"), table.where("false")).collect() == []
    assert scan_table(unit("needle").where("false"), table).collect() == []


def test_places_over_empty_parts(spark):
    rows = spark.range(100).repartition(7).selectExpr("id * 3 AS x").where("x < 40 OR x > 250")
    got = [(r.x, r.place) for r in placed(rows.orderBy("x")).collect()]
    want = sorted(x * 3 for x in range(100) if x * 3 < 40 or x * 3 > 250)
    assert sorted(got) == [(x, i) for i, x in enumerate(want)]
    empty = spark.range(10, numPartitions=5).where("id > 4").withColumnRenamed("id", "x")
    assert sorted((r.x, r.place) for r in placed(empty).collect()) == [(5, 0), (6, 1), (7, 2), (8, 3), (9, 4)]
    assert placed(empty.where("false")).collect() == []
