"""Concatenations against Python's own syntax tree."""

import ast
import random
import time

import pytest
from pyspark.sql import functions as F

from corpus_guard.catalogue import package_rules, standalone_rules
from corpus_guard.catalogue.names import PROMPT_NAMES, TAINTED_NAMES
from corpus_guard.operators.concat import concat_findings, logical_lines, operands
from queries.planted import CODE_BLOCKS

PACKAGE = next((n, r) for n, r in enumerate(package_rules()) if r.kind == "concat")
STANDALONE = next((n, r) for n, r in enumerate(standalone_rules()) if r.kind == "concat")
OPTIONS = {"attributes": False, "literals": ("string", "constant")}


def by_tree(source, standalone):
    """Lines of tainted sums, by walking the tree; None if the source does not parse."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return None

    def tainted(x):
        if isinstance(x, ast.Attribute) and not standalone:
            return x.attr in TAINTED_NAMES
        return isinstance(x, ast.Name) and x.id in TAINTED_NAMES

    def prompt(x):
        if isinstance(x, ast.Constant):
            return standalone or isinstance(x.value, str)
        return isinstance(x, ast.Name) and x.id in PROMPT_NAMES

    found = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            a, b = node.left, node.right
            if tainted(a) and prompt(b) or tainted(b) and prompt(a):
                found.add(node.lineno)
    return sorted(found)


def lines_by_unit(units, rule, **options):
    rows = concat_findings(units, *rule, **options).collect()
    found = {}
    for r in rows:
        found.setdefault(r.unit_id, []).append(r.line)
    return {k: sorted(v) for k, v in found.items()}


def compare(unit, sources):
    units = unit(*sources)
    for rule, options, standalone in ((PACKAGE, {}, False), (STANDALONE, OPTIONS, True)):
        for whole in (False, True):
            got = lines_by_unit(units, rule, whole=whole, **options)
            for i, source in enumerate(sources):
                want = by_tree(source, standalone)
                if want is None and not whole:
                    continue
                assert got.get(str(i), []) == (want or []), (source, whole, standalone)


ATOMS = ["prompt", "user_input", "message", "template", "other", "obj.user_input", "a.b.query", '"x"', "'y # z'", "2.5",
         "None", "True", "b'w'", "0x1F", "1_000", '"""m\nn"""', "('p'\n 'q')", "'it\\'s'", "r'\\d'", "f'{other}'"]


def expression(draw, depth, inside):
    kind = draw.randrange(12) if depth else 0
    gap = draw.choice([" ", "", "  "]) if not inside else draw.choice([" ", "", "\n", "\n   ", "  # prompt + message\n"])

    def sub(within=inside):
        return expression(draw, depth - 1, within)

    if kind in (1, 2, 3, 4):
        return f"{sub()}{gap}+{gap}{sub()}"
    if kind == 5:
        return f"({gap.strip(' ')}{sub(True)}{gap})"
    if kind == 6:
        return f"f({sub(True)},{gap}{sub(True)})"
    if kind == 7:
        return f"{sub()} {draw.choice(['*', '%', '/', '-', '==', 'and', '<', '|', 'if x else', 'in'])} {sub()}"
    if kind == 8:
        return f"[{sub(True)}, {sub(True)}]"
    if kind == 9:
        return f"f(1)[{sub(True)}]"
    if kind == 10:
        return "f'{prompt + message} {other!r:>5}'"
    return draw.choice(ATOMS)


def statement(draw):
    value = expression(draw, draw.randint(1, 4), False)
    return draw.choice(["x = {}", "return_({})", "if {}: pass", "assert {}", "x += {}", "x = {{1: {}}}", "{}", "y = \\\n  {}"]).format(value)


def test_planted_blocks(unit):
    compare(unit, [*CODE_BLOCKS, *(f"def g():\n    x = [1,\n  2]\n    {b.splitlines()[0]}" for b in CODE_BLOCKS)])


@pytest.mark.parametrize("seed", range(3))
def test_random_code(unit, seed):
    draw = random.Random(seed)
    sources = []
    while len(sources) < 250:
        source = "\n".join(statement(draw) for _ in range(draw.randint(1, 4)))
        try:
            tree = ast.parse(source)
        except SyntaxError:
            continue
        # an attribute of a call or a subscript, and more than two parentheses, are stated limits
        deep = "(((" in source.replace("\n", "").replace(" ", "")
        if not deep and not any(isinstance(x, ast.Attribute) and not isinstance(x.value, (ast.Name, ast.Attribute)) for x in ast.walk(tree)):
            sources.append(source)
    assert sum(bool(by_tree(s, True)) for s in sources) > 40
    compare(unit, sources)


def test_logical_lines(spark):
    source = "a = 1\nb = (2,  # two\n  'x\\'y',\n  \"\"\"s\nt\"\"\")\nc = 3 + \\\n  4\nd = b'z' 'w'\n"
    row = spark.createDataFrame([(source,)], "text string").select(F.expr(logical_lines("text")).alias("ls")).first()
    got = [(x.line, x.code.replace("﷒", "|")) for x in row.ls]
    assert got == [(1, "a = 1"), (2, 'b = (2,  |  "",|  ""|)'), (6, "c = 3 + |  4"), (8, 'd = b"" ""'), (9, "")]


def test_units_that_do_not_close(unit):
    """Read line by line, or left out."""
    sources = ["text (with a smile :(\nx = prompt + user_input", "don't\nx = prompt + user_input", 'x = "open\ny = prompt + query']
    units = unit(*sources)
    assert lines_by_unit(units, PACKAGE) == {"0": [2], "1": [2], "2": [2]}
    assert lines_by_unit(units, PACKAGE, whole=True) == {}


def test_odd_texts(unit, spark):
    units = unit(None, "", "+", "user_input +", "﷐﷒ x = prompt + user_input ﷐", "x = prompt +\r\n user_input\r\ny = prompt + query")
    assert lines_by_unit(units, PACKAGE) == {"4": [1], "5": [3]}


def test_long_units_take_linear_time(unit):
    """Many sums, quotes, brackets and escapes in one unit."""

    def seconds(n):
        parts = ["x = prompt + user_input\n", '"""' + "a\" 'b " * 20 + '"""\n', "f(" + "(1," * 30 + ")" * 31 + "\n", "'\\'' + message\n"]
        units = unit("".join(parts) * n).cache()
        units.count()
        start = time.perf_counter()
        assert len(lines_by_unit(units, PACKAGE)["0"]) >= 2 * n
        return time.perf_counter() - start

    seconds(20)
    few, many = seconds(300), seconds(3000)
    assert many < 25 * few + 5, (few, many)


def test_operands_of_one_line(unit):
    rows = unit("x = a.b + 'c'\ny = 1 + z, (q) + w").select(F.inline(F.expr(operands("text")))).collect()
    assert [tuple(r) for r in rows] == [
        (1, "attribute", "b", "string", ""),
        (2, "constant", "", "name", "z"),
        (2, "name", "q", "name", "w"),
    ]
