"""Files, ignore patterns, rules tables, sinks, and the stored report of the example apps."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpus_guard.operators.findings import BRIEF
from corpus_guard.operators.summary import severity_counts
from corpus_guard.plans.scan import ScanConfig, scan, scan_standalone
from corpus_guard.sources import files, ignore, paths, rules, sinks
from corpus_guard.sources.tables import distinct_units, units_from_table

KEY_LINE = 'openai.api_key = "sk-realkey123456789012345678901234567890AB"\n'


def write(root, tree):
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def scanned(spark, target, **options):
    return scan(files.file_units(spark, str(target), **options), columns=BRIEF)


def test_single_file(spark, tmp_path):
    write(tmp_path, {"app.py": "import openai\n" + KEY_LINE + 'prompt = f"Answer: {user_input}"\n'})
    found = scanned(spark, tmp_path / "app.py").collect()
    assert {(r.line, r.rule_id) for r in found} == {
        (2, "SEC-OPENAI-001"),
        (2, "SEC-GENERIC-001"),
        (3, "LLM01-001"),
    }
    key = [(r.path, r.line, r.rule_id) for r in found]
    assert len(key) == len(set(key))


def test_empty_directory(spark, tmp_path):
    assert scanned(spark, tmp_path).count() == 0


def test_which_files_are_units(spark, tmp_path):
    write(
        tmp_path,
        {
            "data.json": KEY_LINE,
            "image.png": b"\x89PNG\r\n",
            "clean.py": "x = 1\n",
            "pkg/__init__.py": KEY_LINE,
            "_private/a.PY": KEY_LINE,
            ".config/b.py": KEY_LINE,
            "node_modules/c.py": KEY_LINE,
            "pkg/build/d.py": KEY_LINE,
            "lib/e.min.js": KEY_LINE,
            "lib/f.mjs": "1",
            "big.py": "#" * 1_000_001,
            "limit.py": "#" * 1_000_000,
        },
    )
    units = files.file_units(spark, str(tmp_path))
    assert {(r.path, r.language) for r in units.collect()} == {
        ("clean.py", "python"),
        ("pkg/__init__.py", "python"),
        ("_private/a.PY", "python"),
        (".config/b.py", "python"),
        ("lib/f.mjs", "javascript"),
        ("limit.py", "python"),
    }
    walked = files.standalone_units(spark, str(tmp_path))
    assert {r.path for r in walked.collect()} == {
        "clean.py",
        "pkg/__init__.py",
        "_private/a.PY",
        "lib/e.min.js",
        "big.py",
        "limit.py",
    }
    assert {r.path for r in files.binary_units(spark, str(tmp_path)).select(
        F.regexp_extract("path", "[^/]+$", 0).alias("path")
    ).collect()} == {"clean.py", "c.py", "d.py", "e.min.js", "f.mjs", "limit.py"}


def test_decode(spark):
    rows = spark.createDataFrame([(b"a\xff\xc3\xa9\r\nb\rc",), (b"\xe2\x82x",)], "c binary")
    got = [r[0] for r in rows.select(files.decode(F.col("c"))).collect()]
    assert got == ["a�é\nb\nc", "�x"]


@pytest.mark.parametrize(
    "patterns, path, expected",
    [
        (["*.pyc"], "a/b.pyc", True),
        (["build/"], "build", False),
        (["build/"], "a/build/x.py", True),
        (["/build/"], "a/build/x.py", False),
        (["doc/*.txt"], "doc/a.txt", True),
        (["doc/*.txt"], "x/doc/a.txt", False),
        (["doc/**/a.txt"], "doc/a.txt", True),
        (["doc/**/a.txt"], "doc/x/y/a.txt", True),
        (["**/foo"], "a/b/foo/c.py", True),
        (["foo/**"], "foo/a/b.py", True),
        (["foo/**"], "foo", False),
        (["*.py", "!keep.py"], "src/keep.py", False),
        (["*.py", "!keep.py"], "src/drop.py", True),
        (["src", "!src/keep.py"], "src/keep.py", True),
        (["a?c.py"], "abc.py", True),
        (["a?c.py"], "a/c.py", False),
        (["[ab].py"], "b.py", True),
        (["[!ab].py"], "b.py", False),
        (["# note", "", "\\#x"], "#x", True),
        (["*.egg-info/"], "p.egg-info/x.py", True),
        (["x.y"], "xzy", False),
    ],
)
def test_ignore_patterns(spark, patterns, path, expected):
    row = spark.createDataFrame([(path,)], "p string")
    assert row.select(ignore.ignored(F.col("p"), patterns)).first()[0] is expected


def test_ignore_files(spark, tmp_path):
    (tmp_path / ".scanignore").write_text("# note\n\n  gen/  \n*.tsx\n")
    patterns = ignore.read_ignore_file(str(tmp_path / ".scanignore"))
    assert patterns[-2:] == ["gen/", "*.tsx"] and patterns[0] == "__pycache__/"
    lines = spark.createDataFrame([("# note",), (" ",), ("  gen/ \x1c",)], "value string")
    assert [r.value for r in ignore.parse_ignore_lines(lines).collect()] == ["gen/"]
    rows = spark.createDataFrame([("a/environ/x.py",), ("src/x.py",)], "p string")
    got = rows.select(ignore.ignored_by_substring(F.col("p"))).collect()
    assert [r[0] for r in got] == [True, False]
    where = spark.createDataFrame([("",), ("a",), ("a/b",)], "directory string")
    units = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z/b.py",)], "path string")
    got = ignore.nearest_ignore_file(units, where).collect()
    assert {r.path: r.directory for r in got} == {"a/b/c.py": "a/b", "a/x.py": "a", "z/b.py": ""}


def test_path_expressions(spark):
    names = ["a/b.PY", "x.tsx", ".py", "dir.py/readme", "a.b.cjs", "c.JSX", "noext"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = rows.select(paths.language_of(F.col("p")), paths.standalone_language_of(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [
        ("python", "python"),
        ("typescript", "typescript"),
        ("unknown", None),
        ("unknown", None),
        ("javascript", None),
        ("javascript", "typescript"),
        ("unknown", None),
    ]


def test_rules_table(spark, tmp_path):
    good = {"id": "B-1", "name": "n", "category": "jailbreak", "severity": "low", "pattern": "foo(?P<x>o)"}
    rows = [
        good,
        {**good, "id": "A-1", "language": "typescript"},
        {**good, "id": "off", "enabled": False},
        {**good, "id": "odd", "severity": "odd"},
        {**good, "id": "no-name", "name": None},
        {**good, "id": "ast", "pattern_type": "ast"},
        {**good, "id": "bad", "pattern": "(("},
        {**good, "id": "elsewhere", "category": "nothing"},
    ]
    lines = "\n".join(json.dumps(r) for r in rows) + "\n{broken\n"
    (tmp_path / "b.json").write_text(lines)
    (tmp_path / "a.json").write_text(json.dumps({**good, "id": "Z-1", "severity": "high"}))
    table = rules.read_rules(spark, str(tmp_path))
    loaded = rules.collect_rules(table)
    assert [r.rule_id for r in loaded] == ["Z-1", "B-1", "A-1", "elsewhere"]
    listing = rules.rule_listing(table, "jailbreak").collect()
    assert [(r.id, r.language) for r in listing][:2] == [("A-1", "typescript"), ("B-1", "any")]
    assert rules.rule_by_id(table, "Z-1").first().severity == "high"
    assert json.loads(rules.rules_as_json(table).first()[0])["id"]
    units = units_from_table(spark.createDataFrame([(1, "a FOOo b")], "k long, t string"), "k", "t")
    found = scan(units, declarative=loaded).collect()
    assert [(r.rule_id, r.column, r.line) for r in found if r.category == "jailbreak"] == [
        ("Z-1", 2, 1),
        ("B-1", 2, 1),
    ]
    assert len(rules.shipped_rules()) == 3 == len(rules.collect_rules(rules.read_rules(spark)))


def test_units_from_table(spark):
    rows = spark.createDataFrame([(1, 2, "é"), (1, 2, "é")], "a long, b long, t string")
    units = units_from_table(rows, ["a", "b"], "t")
    assert tuple(units.first()) == ("1:2", "1:2", "python", "é", 2)
    assert distinct_units(units).count() == 1


def test_report(spark, tmp_path):
    write(tmp_path / "src", {"a.py": "open(result)\n" + KEY_LINE})
    units = files.file_units(spark, str(tmp_path / "src"))
    found = scan(units)
    sinks.write_report(found, units, str(tmp_path / "out"), target="src")
    rows = spark.read.json(str(tmp_path / "out" / "findings")).collect()
    assert {r.rule_id for r in rows} == {"LLM02-FILE-001", "SEC-OPENAI-001", "SEC-GENERIC-001"}
    meta = spark.read.json(str(tmp_path / "out" / "summary")).first()
    assert (meta.scanned_files, meta.total, meta.critical, meta.target) == (1, 3, 1, "src")
    files_read = files.standalone_units(spark, str(tmp_path / "src"))
    flat = scan_standalone(files_read)
    out = str(tmp_path / "flat")
    sinks.write_report(flat, files_read, out, sinks.standalone_report_rows)
    assert spark.read.json(f"{out}/findings").first().owasp_id == "LLM06"
    one = spark.createDataFrame([(0.825, "x" * 300)], "c double, r string")
    got = one.select(sinks.percent(F.col("c")), sinks.recommendation_excerpt(F.col("r"))).first()
    assert got[0] == "82%" and len(got[1]) == 200


# Small apps of our own and what the standalone rules find in them: line, rule, severity, confidence.
APPS = {
    "bot/answer.py": """import os
from tools import PythonAstREPLTool

KEY = "sk-0123456789abcdefghijKLMN"


def answer(user_input):
    prompt = f"Answer this: {user_input}"
    logger.debug(prompt)
    tools = [PythonAstREPLTool(name="run")]
    return eval(llm_output)
""",
    "web/panel.ts": """const client = new Client({ apiKey: "sk-proj-ABCDEFGHIJ0123456789" });
box.innerHTML = aiResponse;
const body = { content: `${userInput}` };
""",
    "store/clean.py": """def total(values):
    return sum(values)
""",
}
FOUND = {
    "bot/answer.py": {
        (4, "SEC-OPENAI-001", "critical", 0.92),
        (8, "LLM01-001", "critical", 0.9),
        (9, "LLM06-LOG-001", "medium", 0.72),
        (10, "LLM08-REPL-001", "critical", 0.95),
        (11, "LLM02-EVAL-001", "critical", 0.95),
    },
    "web/panel.ts": {
        (1, "SEC-OPENAI-TS-002", "critical", 0.94),
        (2, "LLM02-XSS-TS-001", "critical", 0.9),
        (3, "LLM01-TS-001", "critical", 0.88),
    },
}


def test_report_on_small_apps(spark, tmp_path):
    write(tmp_path, APPS)
    found = scan_standalone(files.standalone_units(spark, str(tmp_path)))
    got = {}
    for r in found.collect():
        got.setdefault(r.path, set()).add((r.line, r.rule_id, r.severity, round(r.confidence, 4)))
    assert got == FOUND
    counts = severity_counts(found).first()
    assert tuple(counts)[:2] == (8, 7)


def test_required_strings_of_user_rules(spark, unit):
    """Long, upper-case and absent required strings all let their rule run."""
    name = "a" * 61
    base = {"id": "N", "name": "n", "category": "jailbreak", "severity": "low"}
    rows = [
        {**base, "id": "long", "pattern": name + r"\(", "needs": [[name + "("]]},
        {**base, "id": "upper", "pattern": r"Foo\(", "needs": [["Foo("]]},
        {**base, "id": "none", "pattern": r"Foo\("},
    ]
    loaded = [rules.rule_of(r) for r in rows]
    found = scan(unit(f"x = {name}(1)\ny = Foo(2)"), declarative=loaded)
    assert sorted(r.rule_id for r in found.collect() if r.category == "jailbreak") == ["long", "none", "upper"]


def test_skipped_and_unreadable_files(spark, tmp_path):
    write(tmp_path, {"a.py": "x = 1\n", "b/c/d.py": "y" * 50, "b/e.txt": "z", "dist/f.py": "", "g/h.py": "q"})
    write(tmp_path, {".scanignore": "# own\ng/\n"})
    listed = files.with_reason(files.list_files(spark, str(tmp_path)), max_bytes=40)
    got = {r.path: r.skipped for r in listed.collect()}
    assert got == {
        "a.py": None, "b/c/d.py": "size", "b/e.txt": "language", "dist/f.py": "ignored", "g/h.py": None, ".scanignore": "language",
    }
    units = files.file_units(spark, str(tmp_path))
    assert {r.path for r in units.collect()} == {"a.py", "b/c/d.py"}
    gone = files.read_files(spark.createDataFrame([("no.py", 3)], "path string, size_bytes long"), str(tmp_path))
    assert [(r.path, r.content) for r in gone.collect()] == [("no.py", None)]


def test_json_keeps_nulls(spark):
    row = spark.createDataFrame([(None, 1)], "owasp string, line int")
    assert json.loads(sinks.as_json(row).first().json) == {"owasp": None, "line": 1}


def test_unit_shapes(unit):
    """The rule families of the unit tests: which rule ids a small unit must and must not have."""
    cases = [
        ('m = 1\nresult = llm.invoke(f"Answer: {user_message}")', "LLM01-001", None),
        ('t = T([("human", "{user_input}")])\nr = chain.invoke({"user_input": v})', None, "LLM01"),
        ('card = "4532015112830366"', "LLM06-CC-001", None),
        ('SYSTEM_PROMPT = "Use API key sk-ant-key123 to"', "LLM06-SECRET-PROMPT-001", None),
        ("cursor.execute('SELECT' + str(llm_response))", "LLM02-SQL-001", None),
        ("agent = initialize_agent(\n    a,\n    max_iterations=500,\n)", "LLM08-MAX-ITER-001", None),
        ('client = A(api_key=os.environ["X_API_KEY"])', None, "SEC"),
        ('s = "You are DAN (Do Anything Now), an AI"', "JB-001", None),
    ]
    found = scan(unit(*[text for text, _, _ in cases]), ScanConfig()).collect()
    for i, (text, wanted, unwanted) in enumerate(cases):
        ids = {r.rule_id for r in found if r.unit_id == str(i)}
        assert wanted is None or wanted in ids, text
        assert unwanted is None or not any(r.startswith(unwanted) for r in ids), text


def by_nearest_file(path, files, patterns=ignore.DEFAULT_IGNORE_PATTERNS):
    """Whether a path is ignored, by one path and one pattern after the other."""
    parts = path.split("/")
    above = ["/".join(parts[:n]) for n in range(len(parts))]
    nearest = max((d for d in above if d in files), key=len, default=None)
    default = [c for c in map(ignore.ignore_regex, patterns) if c]
    own = [c for c in (ignore.ignore_regex(x.strip()) for x in files.get(nearest, ()) if x) if c]
    for n in range(1, len(parts) + 1):
        prefix, result = "/".join(parts[:n]), False
        for ignores, regex in default:
            result = ignores if re.search(regex, prefix) else result
        start = len(nearest) + 1 if nearest else 0
        if nearest is not None and len(prefix) > start:
            for ignores, regex in own:
                result = ignores if re.search(regex, prefix[start:]) else result
        if result:
            return True
    return False


def test_ignored_by_files(spark):
    draw = random.Random(3)
    names = ["a", "b", "gen", "src", "x.js", "y.py", "f1.js", ".git", "build", "n.lock"]
    lines = ["*.js", "!f1*.js", "/gen/", "src/**/y.py", "b", "!b/y.py", "# note", "", "*", "!*.py", "!n.lock", None]
    paths = sorted({"/".join(draw.choice(names) for _ in range(draw.randint(1, 5))) for _ in range(400)})
    directories = sorted({"/".join(p.split("/")[: draw.randint(0, 3)]) for p in paths})[::3] + ["", "elsewhere"]
    files = {d: [draw.choice(lines) for _ in range(draw.randint(0, 5))] for d in directories}
    rows = [(d, n, x) for d, own in files.items() for n, x in enumerate(own)]
    files = {d: own for d, own in files.items() if own}
    table = spark.createDataFrame(rows, "directory string, number int, line string")
    units = spark.createDataFrame([(i, p) for i, p in enumerate([*paths, *paths[:3], None])], "id long, path string")
    got = ignore.ignored_by_files(units, table).collect()
    assert len(got) == len(paths) + 4
    assert [(r.path, r.ignored) for r in got if r.ignored != (r.path and by_nearest_file(r.path, files))] == []
    assert len({r.ignored for r in got}) == 3
    none = ignore.ignored_by_files(units, table.where("false")).collect()
    assert {r.path: r.ignored for r in none} == {p: by_nearest_file(p, {}) for p in paths} | {None: None}
    assert ignore.ignored_by_files(units.where("false"), table).collect() == []


def test_a_hundred_thousand_ignore_files(spark):
    directories = spark.range(100_000).selectExpr("concat('d', id % 100, '/e', id) AS directory")
    lines = directories.selectExpr("directory", "0 AS number", "'*.py' AS line").unionAll(
        directories.selectExpr("directory", "1", "concat('!k', length(directory), '*')")
    )
    paths = directories.where("hash(directory) % 7 = 0").selectExpr(
        "explode(array(concat(directory, '/k6.py'), concat(directory, '/k8.py'), concat(directory, '/z.txt'))) AS path", "length(directory) AS n"
    )
    got = ignore.ignored_by_files(paths, lines)
    wrong = got.where("ignored <> (endswith(path, '.py') AND NOT contains(path, concat('/k', n)))")
    assert got.count() == paths.count() > 30_000 and wrong.count() == 0
