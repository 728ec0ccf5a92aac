"""Document fingerprints: SimHash of 128 bits, and all fingerprints within a Hamming radius.

Terms are words, lower-cased. Each occurrence votes on every bit by its hash, with a weight of its
characters, up to ``MOST_WEIGHT``: long words say more. A bit is set if more than half of the weight
votes for it. (Of documents whose five-word shingles overlap by 75 % or more, 94 % are within 12
bits; pairs of words as terms bring 53 % that near.)

Votes are counted as sums of packed longs: the bits j, j + 16, j + 32 and j + 48 of a hash, times
the weight, are added in four lanes of 16 bits. A group of ``GROUP`` terms keeps below 15 bits in each, so the
highest lane never reaches the sign.

To find near fingerprints the bits are cut into permuted blocks. Fingerprints within the radius differ
in at most radius / blocks bits of some block, so every fingerprint is in one table per block by that
block's bits, and a query looks up all values that differ from its own in so few bits. The query side
is multiplied by that, the table side only by the number of blocks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_guard.llm.shared import ROW, checked, row_key, table, written

BITS = 128
MOST_WEIGHT = 31
GROUP = 1024
LANES = 0x0001000100010001
#: Documents by ids whose texts one group holds, to give each the text of the next.
IDS = 1024
BUCKETS = 4096
#: Bits that near fingerprints differ in at most, and blocks.
RADIUS, BLOCKS = 12, 5

_WORDS = r"filter(split(lower({text}), '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')"
_TERMS = f"""transform(words, a ->
    named_struct('hash', xxhash64(a), 'weight', least(length(a), {MOST_WEIGHT})))"""


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, high and low (the halves of the fingerprint) of every row of ``texts`` (text).

    ``keys`` name a row. Null texts, empty ones and texts of blanks have no terms and get zeros.
    """
    terms = texts.select(*keys, F.expr(_WORDS.format(text="coalesce(text, '')")).alias("words"))
    terms = terms.select(*keys, F.expr(f"posexplode_outer(CASE WHEN size(words) > 0 THEN {_TERMS} END)").alias("at", "term"))
    hashes = (F.col("term.hash"), F.xxhash64("term.hash"))
    votes = [
        F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) * F.col("term.weight")).alias(f"v{half}_{j}")
        for half, h in enumerate(hashes)
        for j in range(16)
    ]
    group = F.floor(F.col("at") / GROUP).alias("group")
    counted = terms.groupBy(*keys, group).agg(F.sum("term.weight").alias("weight"), *votes)
    groups = counted.groupBy(*keys).agg(
        F.collect_list(
            F.struct("weight", *[F.array(*[f"v{half}_{j}" for j in range(16)]).alias(f"h{half}") for half in (0, 1)])
        ).alias("groups"),
        F.sum("weight").alias("weight"),
    )
    bit = """aggregate(sequence(0, 63), 0L, (bits, b) -> bits | IF(
        2 * aggregate(groups, 0L, (n, g) ->
            n + (shiftrightunsigned(element_at(g.{half}, b % 16 + 1), 16 * CAST(b DIV 16 AS INT)) & 65535L)) > weight,
        shiftleft(1L, b), 0L))"""
    none = F.col("weight").isNull()
    halves = [
        F.when(none, F.lit(0).cast("long")).otherwise(F.expr(bit.format(half=half))).alias(name)
        for half, name in (("h0", "high"), ("h1", "low"))
    ]
    return groups.select(*keys, *halves)


def distance(other_high: str, other_low: str) -> Column:
    """Bits in which high and low differ from two other columns."""
    return F.bit_count(F.col("high").bitwiseXOR(F.col(other_high))) + F.bit_count(
        F.col("low").bitwiseXOR(F.col(other_low))
    )


def hexed(high: str, low: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(c)), 16, "0") for c in (high, low)]))


def _with_next(docs: DataFrame) -> DataFrame:
    """bucket, extra, doc_id, ROW, text and next_text, by ascending doc_id, then by contents.

    Ids of one bucket are one group. The first row of a bucket is also an extra last row of the
    bucket before it; the first of all that of the last bucket.
    """
    docs = docs.select("doc_id", "text").withColumn(ROW, row_key("doc_id", "text"))
    # null ids come first, in a bucket of their own
    bucket = F.coalesce(F.floor(F.col("doc_id") / IDS), F.lit(-(1 << 62)))
    docs = docs.withColumn("bucket", bucket)
    firsts = docs.groupBy("bucket").agg(F.min(F.struct("doc_id", ROW)).alias("first"))
    firsts = written(firsts.withColumn("part", F.floor(F.col("bucket") / BUCKETS)))
    inside = Window.partitionBy("part").orderBy("bucket")
    parts = firsts.groupBy("part").agg(F.min("bucket").alias("bucket"))
    # one row for IDS * BUCKETS ids
    parts = parts.select("part", F.lag("part").over(Window.orderBy("part")).alias("part_before"))
    lasts = firsts.groupBy("part").agg(F.max("bucket").alias("last"))
    lasts = lasts.select(F.col("part").alias("part_before"), "last")
    ends = firsts.agg(F.max("bucket").alias("last")).first()
    before = firsts.withColumn("before", F.lag("bucket").over(inside))
    before = before.join(parts.join(lasts, "part_before", "left"), "part")
    before = F.coalesce("before", "last", F.lit(ends.last)).alias("target"), before
    targets = before[1].select(F.col("first.doc_id").alias("doc_id"), F.col(f"first.{ROW}").alias(ROW), before[0])
    found = docs.alias("d").join(
        checked(written(targets)).alias("t"),
        F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col(f"d.{ROW}") == F.col(f"t.{ROW}")),
        "left",
    )
    places = F.when(
        F.col("target").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra")))
    ).otherwise(
        F.array(
            F.struct(F.col("bucket"), F.lit(False).alias("extra")),
            F.struct(F.col("target").alias("bucket"), F.lit(True).alias("extra")),
        )
    )
    placed = found.select(F.explode(places).alias("place"), "d.doc_id", f"d.{ROW}", "text")
    placed = placed.select("place.bucket", "place.extra", "doc_id", ROW, "text")
    order = Window.partitionBy("bucket").orderBy("extra", "doc_id", ROW)
    return placed.withColumn("next_text", F.lead("text").over(order)).withColumn("seq", F.row_number().over(order))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, high, low, edited_high, edited_low, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the
    next document's, or by all it has. Null texts count as empty. Of equal ids the order is that of
    a hash of the text; repeated rows stay. A table of one row has itself as next. Columns but
    doc_id and text are ignored.
    """
    rows = _with_next(docs)
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.select("bucket", "seq", "extra", "doc_id", text.alias("text"), after.alias("next_text"))
    rows = rows.select(
        "bucket",
        "seq",
        "extra",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "text",
        F.concat(F.expr("left(text, length(text) - CAST(length(text) DIV 2 AS INT))"), F.expr("left(next_text, CAST(length(text) DIV 2 AS INT))")).alias("edited"),
    )
    both = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn(
        "version",
        F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))),
    )
    keys = ["bucket", "seq", "extra", "doc_id", "n_chars", "edited_sha256"]
    # an extra row is only there to be compared with
    both = both.select(*keys, "version.which", "version.text").where("which = 0 OR NOT extra")
    marks = fingerprints(both, [*keys, "which"])
    halves = [
        F.max(F.when(F.col("which") == which, F.col(half))).alias(f"{name}{half}")
        for which, name in ((0, ""), (1, "edited_"))
        for half in ("high", "low")
    ]
    marks = marks.groupBy(*keys).agg(*halves)
    order = Window.partitionBy("bucket").orderBy("seq")
    marks = marks.withColumns({f"next_{h}": F.lead(h).over(order) for h in ("high", "low")}).where("NOT extra")
    return marks.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "high",
        "low",
        "edited_high",
        "edited_low",
        (1 - distance("edited_high", "edited_low") / BITS).alias("near_edited"),
        (1 - distance("next_high", "next_low") / BITS).alias("near_next"),
    )


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """First bit and size of every block, of about equal sizes."""
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    return [(at, end - at) for at, end in zip(ends, ends[1:])]


def _bits(at: int, size: int, high: str = "high", low: str = "low") -> Column:
    """The bits [at, at + size) of a fingerprint, counted from the lowest, as a long."""
    if at >= 64:
        bits = F.shiftrightunsigned(F.col(high), at - 64)
    elif at + size <= 64:
        bits = F.shiftrightunsigned(F.col(low), at)
    else:
        bits = F.shiftrightunsigned(F.col(low), at).bitwiseOR(F.shiftleft(F.col(high), 64 - at))
    return bits.bitwiseAND(F.lit((1 << size) - 1))


def _flips(size: int, most: int) -> Column:
    """All patterns of ``size`` bits with at most ``most`` set."""
    return F.lit([sum(1 << i for i in chosen) for n in range(most + 1) for chosen in combinations(range(size), n)])


def _asked(n: int, at: int, size: int, most: int) -> Column:
    """(block, value) of all values that differ from block ``n`` in at most ``most`` bits."""
    return F.transform(
        _flips(size, most),
        lambda x: F.struct(F.lit(n).alias("block"), _bits(at, size).bitwiseXOR(x).alias("value")),
    )


def within(marks: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs of fingerprints of ``queries`` and ``marks`` (high, low) at most ``radius`` apart.

    Columns: high, low of the query, other_high, other_low and distance. Equal fingerprints are
    taken once on either side, and paired too. Every pair is found, once: in the first block that
    differs in few enough bits.
    """
    cuts, most = _blocks(blocks), radius // blocks
    tables = [F.struct(F.lit(n).alias("block"), _bits(*cut).alias("value")) for n, cut in enumerate(cuts)]
    other = marks.select("high", "low").distinct().select("high", "low", F.inline(F.array(*tables)))
    other = other.withColumnsRenamed({c: f"other_{c}" for c in ("high", "low", "block", "value")})
    asked = [_asked(n, *cut, most) for n, cut in enumerate(cuts)]
    asked = queries.select("high", "low").distinct().select("high", "low", F.inline(F.flatten(F.array(*asked))))
    apart = distance("other_high", "other_low")
    first = F.lit(-1)
    for n, cut in reversed(list(enumerate(cuts))):
        few = F.bit_count(_bits(*cut).bitwiseXOR(_bits(*cut, "other_high", "other_low"))) <= most
        first = F.when(few, F.lit(n)).otherwise(first)
    same = (F.col("block") == F.col("other_block")) & (F.col("value") == F.col("other_value"))
    # the rows of the tables are not known to be few: they are shuffled, whatever the estimate
    met = asked.join(other.hint("merge"), same & (apart <= radius) & (F.col("block") == first))
    return met.select("high", "low", "other_high", "other_low", apart.alias("distance"))


def op6(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the search for near ones.

    Documents of equal fingerprints are a class: class_id is its smallest doc_id, n_equal its rows.
    For ids divisible by 50: n_near, the other rows of the table within ``RADIUS`` bits, equal ones
    included, and near_class, the smallest class_id among other classes that near; else null.
    """
    marks = written(compared(table(spark, sf_dir, "documents")))
    classes = written(marks.groupBy("high", "low").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_equal")))
    pairs = within(marks, marks.where("doc_id % 50 = 0")).where("distance > 0")
    other = classes.withColumnsRenamed({"high": "other_high", "low": "other_low", "class_id": "near_class", "n_equal": "n_other"})
    near = pairs.join(other, ["other_high", "other_low"]).groupBy("high", "low").agg(
        F.sum("n_other").alias("n_other"), F.min("near_class").alias("near_class")
    )
    facts = classes.join(near, ["high", "low"], "left")
    queried = F.col("doc_id") % 50 == 0
    n_near = F.col("n_equal") - 1 + F.coalesce("n_other", F.lit(0).cast("long"))
    return marks.join(facts, ["high", "low"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed("high", "low").alias("fingerprint"),
        hexed("edited_high", "edited_low").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "class_id",
        "n_equal",
        F.when(queried, n_near).alias("n_near"),
        F.when(queried, F.col("near_class")).alias("near_class"),
    )
