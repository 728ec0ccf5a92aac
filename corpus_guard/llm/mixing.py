"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the corpus, so each of its documents has a mean number of
repetitions. A number drawn from a hash of seed and doc_id is put through the inverse of the
Poisson distribution with that mean, the document is repeated so often, and all copies are dealt to
partitions and ordered inside them by another hash: a global shuffle that a rerun repeats exactly.

A mean of any size is allowed: beyond ``part`` it is cut into equal parts, each with a draw of its own,
as a sum of Poisson numbers is one of the summed mean. So the table of chances stays short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_guard.llm.shared import table, written


@dataclass(frozen=True)
class Mix:
    """``epochs``: size of the result in sizes of the input. ``part``: largest mean of one draw.
    ``broadcast_sources``: sources up to which their table is broadcast.
    """

    seed: str = "mix"
    epochs: float = 1.0
    part: float = 8.0
    broadcast_sources: int = 100_000
    salts: int = 64


MIX = Mix()
COLUMNS = ("copy", "order_key")


def _identity() -> Column:
    """What a document is drawn by: its doc_id, or a hash of its text where it has none."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), text))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from a hash of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / float(1 << 52)


def rates(docs: DataFrame, targets: DataFrame | None = None, mix: Mix = MIX) -> DataFrame:
    """source, rate, parts and cdf of every source: rate is cut into so many parts, and cdf has the
    chances of 0, of at most 1, ... repetitions by one of them.

    A document's size is its characters plus one. Without ``targets`` (source, weight) a source
    weighs the square root of its size, which evens sources out. With them, a source that is not
    named, or whose weight is null or negative, gets rate 0; a null source is a source as any.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1
    have = docs.groupBy("source").agg(F.sum(size).alias("have"))
    if targets is None:
        have = have.withColumn("weight", F.sqrt("have"))
    else:
        named = targets.groupBy(F.col("source").alias("named")).agg(F.sum("weight").alias("weight"))
        have = have.join(named, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
        have = have.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    have = written(have)
    total = have.agg(F.sum("have").alias("have"), F.sum("weight").alias("weight")).first()
    if not total.weight:
        rate = F.lit(0.0)
    else:
        rate = F.col("weight") / F.lit(float(total.weight)) * F.lit(mix.epochs * total.have) / F.col("have")
    have = have.select("source", rate.alias("rate"))
    have = have.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / mix.part)).cast("int"))
    last = int(mix.part + 12 * mix.part**0.5 + 20)
    chances = f"""
        aggregate(
            sequence(1, {last}),
            named_struct('p', exp(-rate / parts), 'cdf', array(exp(-rate / parts))),
            (s, k) -> named_struct(
                'p', s.p * rate / parts / k,
                'cdf', concat(s.cdf, array(element_at(s.cdf, -1) + s.p * rate / parts / k))),
            s -> s.cdf)"""
    return have.select("source", "rate", "parts").withColumn("cdf", F.expr(chances))


def planned(docs: DataFrame, targets: DataFrame | None = None, mix: Mix = MIX) -> DataFrame:
    """source, documents, rate, share and expected: target share of the characters, and mean characters
    of the result, by source."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1
    have = docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum(size).alias("have"))
    known = rates(docs, targets, mix).select(F.col("source").alias("named"), "rate")
    rows = have.join(known, F.col("source").eqNullSafe(F.col("named")))
    rows = written(rows.withColumn("expected", F.col("rate") * F.col("have")))
    total = rows.agg(F.sum("expected")).first()[0]
    share = F.col("expected") / F.lit(total) if total else F.lit(0.0)
    return rows.select("source", "documents", "rate", share.alias("share"), "expected")


def mixed(docs: DataFrame, targets: DataFrame | None = None, mix: Mix = MIX) -> DataFrame:
    """The repeated documents: columns of ``docs``, copy (1, 2, ...) and order_key.

    Rows of equal doc_id draw the same number; those without one draw by their text. Null and empty
    texts are repeated as others of their source. Columns of ``docs`` named copy or order_key are
    replaced. An empty input gives an empty result.
    """
    docs = docs.drop(*COLUMNS)
    known = written(rates(docs, targets, mix))
    rate = known.select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf"), F.col("parts").alias("__parts"))
    same = F.col("source").eqNullSafe(F.col("__source"))
    if known.limit(mix.broadcast_sources + 1).count() <= mix.broadcast_sources:
        dealt = docs.join(F.broadcast(rate), same)
    else:
        # too many sources to broadcast: each is dealt to several groups, as one may be very large
        salt = F.expr(f"explode(sequence(0, {mix.salts - 1}))")
        rate = rate.withColumn("__salt", salt)
        own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(mix.salts)).cast("int")
        dealt = docs.withColumn("__own", own)
        dealt = dealt.join(rate, same & (F.col("__own") == F.col("__salt"))).drop("__own", "__salt")
    dealt = dealt.withColumn("__id", _identity())
    first = _uniform(F.lit(mix.seed), F.col("__id"))
    dealt = dealt.withColumn("__draw", first).withColumn("__times", F.expr("size(filter(__cdf, c -> c <= __draw))"))
    # the draws of the parts behind the first
    more = F.when(F.col("__parts") > 1, F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("__parts"))))
    draws = F.transform(more, lambda i: _uniform(F.lit(mix.seed), F.col("__id"), F.lit("part"), i.cast("string")))
    dealt = dealt.withColumn("__draws", draws)
    rest = "aggregate(__draws, 0, (n, d) -> n + size(filter(__cdf, c -> c <= d)))"
    dealt = dealt.withColumn("__times", F.col("__times") + F.coalesce(F.expr(rest), F.lit(0)))
    dealt = dealt.where("__times > 0").drop("__cdf", "__draw", "__draws", "__parts", "__source")
    copies = dealt.withColumn("copy", F.expr("explode(sequence(1, __times))")).drop("__times")
    parts = (F.lit(mix.seed), F.lit("order"), F.col("__id"), F.col("copy").cast("string"))
    key = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return copies.withColumn("order_key", key).drop("__id").repartition("order_key").sortWithinPartitions("order_key")


def op2(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


OP2_SQL = f"""
WITH sizes AS (
    SELECT source, sum(coalesce(length(text), 0) + 1) AS have FROM documents GROUP BY source
), weights AS (
    SELECT source, have, sqrt(have) AS weight FROM sizes
), whole AS (
    SELECT source, weight / (SELECT sum(weight) FROM weights) * ({MIX.epochs} * (SELECT sum(have) FROM weights)) / have AS rate
    FROM weights
), rates AS (
    SELECT source, greatest(1, ceil(rate / {MIX.part}))::INTEGER AS parts, rate / greatest(1, ceil(rate / {MIX.part})) AS rate
    FROM whole
), steps AS (
    SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
    FROM rates, range(0, 80) AS r(k)
), chances AS (
    SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM steps
), named AS (
    SELECT d.*, parts, coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, ''))) AS id
    FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), draws AS (
    SELECT *, ('0x' || substr(md5('{MIX.seed}|' || id || CASE WHEN part > 1 THEN '|part|' || part ELSE '' END), 1, 13))::BIGINT
        / 4503599627370496.0 AS draw
    FROM (SELECT *, unnest(range(1, parts + 1)) AS part FROM named)
), counted AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.id, count(*) AS times
    FROM draws d JOIN chances c ON d.source IS NOT DISTINCT FROM c.source AND c.below <= d.draw
    GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
    md5('{MIX.seed}|order|' || id || '|' || copy) AS order_key
FROM counted, LATERAL (SELECT unnest(range(1, times + 1)) AS copy)
"""
