"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is its set of distinct word shingles, as 64-bit hashes; documents of equal sets are one
node. Shingles are ordered by estimated frequency, rare ones first. Two sets that are similar
enough share at least l of the first (size - least overlap + l) shingles of each, for any l; a
document picks the l whose estimated cost is least. Two documents are candidates when their
prefixes share as many shingles as the smaller l asks for, and candidates are verified exactly.
Shingles of the same nodes, as those of a group's common text, are one token with their number as weight.

``grouped`` gives components by verified pairs of sets that span them, and the membership of rows in
sets. Pairs inside a dense group need not be listed for that: first the nodes of shingles with many
nodes are verified against few pivots, which joins most of a group with a number of pairs that grows
with the nodes. Candidates are then listed only between nodes that are still in different components.

``linked`` finds every link, whose number grows with the square of a group: all candidates are listed,
those of a frequent shingle by pairs of blocks of its nodes, and verified where blocks of nodes meet.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_guard.llm import arrays
from corpus_guard.llm.components import components
from corpus_guard.llm.shared import ROW, checked, removed, row_key, stored, table, without, written


@dataclass(frozen=True)
class Join:
    """``percent``: least similarity. ``most_shared``: largest l. ``counters``: size of the table of
    estimated frequencies, the same for any input. ``verify``: cost of comparing one shingle in
    units of one prefix entry. ``chance``: how many other documents are taken to hold a shingle that
    is not known to be frequent. ``salt_over``: entries of one shingle that one group takes, by
    estimate. ``marks``: size of the table that picks the texts to verify, in bits.
    ``pivot_rounds``: how often nodes are tried against pivots before candidates are listed, in
    round i against ``pivots`` ** i of them;
    ``dense``: nodes of a shingle that are few enough to list their pairs at once. ``block``: nodes
    of a shingle, and root of the number of pairs, that one group takes when every link is asked for.
    """

    words: int = 5
    percent: int = 75
    most_shared: int = 24
    counters: int = 1 << 23
    verify: float = 0.1
    chance: float = 0.25
    salt_over: int = 4096
    marks: int = 1 << 22
    pivot_rounds: int = 3
    pivots: int = 8
    dense: int = 6
    block: int = 256


JOIN = Join()
_CHUNK = 1 << 16
#: A prefix entry is a shingle's upper 52 bits; the lower 12 name the group of a frequent one.
_SALTS = 0xFFF


def shingle_sets(column: pa.Array, words: int):
    """The sorted distinct shingles of every text, as (text number, shingles); a text of fewer
    words is one shingle, a text without words has none and is left out."""
    data, offsets = arrays.text_bytes(column)
    for first, last in arrays.blocks(offsets):
        part = arrays.LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, owner = arrays.word_spans(part, offsets[first : last + 1] - offsets[first])
        hashes = arrays.word_hashes(part, starts, ends)
        counts = np.bincount(owner, minlength=last - first)
        keys, text = arrays.grams(hashes, owner, words)
        sizes = np.bincount(text, minlength=last - first)
        word_at, key_at = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
        for i in range(last - first):
            if sizes[i]:
                yield first + i, np.unique(keys[key_at[i] : key_at[i] + sizes[i]])
            elif counts[i]:
                own = hashes[word_at[i] : word_at[i] + counts[i]]
                yield first + i, arrays.grams(own, np.zeros(len(own), np.int64), len(own))[0]


def slots(keys: np.ndarray, counters: int) -> np.ndarray:
    return (arrays.salted(keys, 3) & np.uint64(counters - 1)).astype(np.int64)


def _batch(chunks: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """Chunks of counters, compressed by planes of equal bytes, as most are small."""
    packed = [zlib.compress(own.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for _, own in chunks]
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk for chunk, _ in chunks], pa.int32()), pa.array(packed, pa.binary())],
        ["chunk", "counts"],
    )


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def tallied(frame: DataFrame, keys_of, counters: int) -> np.ndarray:
    """How many keys fall on each of ``counters`` counters; ``keys_of`` gives a batch's keys.

    Every task sends its counters that are not zero, in chunks, and chunks are added where they
    meet. The driver gets the sum, whose size does not depend on the input.
    """

    def count(batches):
        total = np.zeros(counters, np.uint32)
        for batch in batches:
            for keys in keys_of(batch):
                places, seen = np.unique(slots(keys, counters), return_counts=True)
                total[places] += seen.astype(np.uint32)
        parts = total.reshape(-1, min(_CHUNK, counters))
        used = np.flatnonzero(parts.any(axis=1))
        for i in range(0, len(used), 16):
            yield _batch([(int(j), parts[j]) for j in used[i : i + 16]])

    def add(batches):
        total = {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                own = _unpacked(packed.as_py())
                total[chunk] = total[chunk] + own if chunk in total else own
        for chunk, own in total.items():
            yield _batch([(chunk, own)])

    kind = "chunk int, counts binary"
    total = np.zeros(counters, np.uint32)
    parts = total.reshape(-1, min(_CHUNK, counters))
    for row in frame.mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind).collect():
        parts[row.chunk] = _unpacked(row.counts)
    return total


class Frequency:
    """Estimated number of documents of a shingle: what its counter holds above the usual load.

    Kept as powers of two: one byte a counter.
    """

    def __init__(self, counters: np.ndarray):
        load = np.float32(np.median(counters[:: max(1, len(counters) >> 16)]))
        self.power = np.zeros(len(counters), np.uint8)
        for i in range(0, len(counters), _CHUNK):
            above = counters[i : i + _CHUNK] - load
            above[above < 4 * np.sqrt(load) + 2] = 1
            self.power[i : i + _CHUNK] = np.log2(above)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return np.exp2(self.power[slots(keys, len(self.power))].astype(np.float32))


def prefix(keys: np.ndarray, seen: np.ndarray, join: Join) -> tuple[int, np.ndarray, np.ndarray]:
    """l, the prefix of the set for it, and the estimated frequencies of its shingles."""
    size = len(keys)
    least = -(-join.percent * size // 100)
    most = min(join.most_shared, least)
    order = np.lexsort((keys, seen))[: size - least + most]
    seen = seen[order]
    entries = np.cumsum(seen)[size - least :]
    others = np.cumsum(seen - 1 + join.chance)[size - least :]
    shared = np.arange(1, most + 1)
    best = int(np.argmin(entries + join.verify * size * others / shared)) + 1
    kept = size - least + best
    return best, keys[order[:kept]], seen[:kept]


def _node(keys: np.ndarray) -> np.uint64:
    """The same for equal sets."""
    total = np.array([np.add.reduce(arrays.salted(keys, 1)), len(keys)], np.uint64)
    return arrays.grams(total, np.zeros(2, np.int64), 2)[0][0]


def _nodes(frequency, join: Join):
    low = np.uint64(_SALTS)

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            sizes, needs = np.zeros(count, np.int64), np.zeros(count, np.int32)
            node = np.zeros(count, np.uint64)
            entries = [np.zeros(0, np.uint64)] * count
            for i, keys in shingle_sets(batch.column("text"), join.words):
                sizes[i], node[i] = len(keys), _node(keys)
                needs[i], tokens, seen = prefix(keys, frequency.value.of(keys), join)
                groups = np.minimum(seen // join.salt_over, _SALTS - 1).astype(np.uint64)
                salt = np.where(groups > 0, 1 + node[i] % (groups + np.uint64(1)), 0).astype(np.uint64)
                entries[i] = (tokens & ~low) | salt
            ends = pa.array(np.cumsum([0] + [len(t) for t in entries]), pa.int32())
            flat = np.concatenate([*entries, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(sizes),
                    pa.array(node.view(np.int64), mask=sizes == 0),
                    pa.array(needs),
                    pa.ListArray.from_arrays(ends, pa.array(flat)),
                ],
                ["doc_id", "row", "n_shingles", "node", "need", "entries"],
            )

    return run


def _sets(marks, join: Join):
    """Node and shingles of the texts whose rows are marked."""

    def run(batches):
        for batch in batches:
            at = slots(np.asarray(batch.column("row")).view(np.uint64), join.marks)
            marked = (marks.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            texts = batch.column("text").filter(pa.array(marked.astype(bool)))
            found = [keys for _, keys in shingle_sets(texts, join.words)]
            ends = pa.array(np.cumsum([0] + [len(k) for k in found]), pa.int32())
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            nodes = np.array([_node(k) for k in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "shingles"]
            )

    return run


def _sets_of(pairs: DataFrame, rows: DataFrame, facts: DataFrame, join: Join) -> DataFrame:
    """node and shingles of the nodes in ``pairs``, which is read more than once.

    Only sets of nodes in a pair are made again from their texts, which a table of fixed size picks;
    what it lets through besides is dropped by the join with the nodes.
    """
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    wanted = written(facts.join(nodes, "node", "left_semi").select("node", "row"))

    def picked(batch):
        yield np.asarray(batch.column("row")).view(np.uint64)

    marks = np.packbits(tallied(wanted.select("row"), picked, join.marks) > 0)
    marks = rows.sparkSession.sparkContext.broadcast(marks)
    sets = rows.select("row", "text").mapInArrow(_sets(marks, join), "node long, shingles array<long>")
    sets = sets.join(wanted.select("node"), "node", "left_semi")
    return sets.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, rows: DataFrame, facts: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; ``pairs`` is read more than once."""
    sets = _sets_of(pairs, rows, facts, join)
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(common * 100 >= union * join.percent).select("a", "b")


def _similar(percent: int):
    """For the pairs and the sets of two blocks: the pairs whose sets are similar enough."""

    def run(pairs, sets):
        known = {n: np.asarray(x, np.int64) for n, x in zip(sets["node"], sets["shingles"])}
        kept = [pairs.iloc[:0]]
        for a, own in pairs.groupby("a"):
            x, others = np.sort(known[a]), [known[b] for b in own["b"]]
            sizes = np.array([len(y) for y in others])
            flat = np.concatenate(others)
            hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            kept.append(own[common * 100 >= (len(x) + sizes - common) * percent])
        return pd.concat(kept)[["a", "b"]]

    return run


def _verified_in_blocks(pairs: DataFrame, rows: DataFrame, facts: DataFrame, join: Join) -> DataFrame:
    """As ``_verified``, for many pairs of few nodes: a set is sent to the blocks it has partners in."""
    sets = written(_sets_of(pairs, rows, facts, join))
    blocks = math.ceil(max(math.sqrt(pairs.count()) / join.block, sets.count() / join.block / 16, 1))
    placed = pairs.withColumns({x: F.pmod(F.xxhash64(n), F.lit(blocks)) for x, n in (("x", "a"), ("y", "b"))})
    wanted = placed.select("x", "y", F.col("a").alias("node")).unionAll(placed.select("x", "y", "b")).distinct()
    sent = written(wanted.join(sets, "node"))
    return placed.groupBy("x", "y").cogroup(sent.groupBy("x", "y")).applyInPandas(_similar(join.percent), "a long, b long")


def _fits(size: str, other: str, percent: int):
    """Sizes that allow the similarity."""
    return (F.col(size) * 100 >= F.col(other) * percent) & (F.col(other) * 100 >= F.col(size) * percent)


def _several(entries: DataFrame) -> DataFrame:
    """The tokens of ``entries`` (token, root) whose nodes are in several components."""
    roots = entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return roots.where("low <> high").select("token")


def _pivot_pairs(entries: DataFrame, now: DataFrame, join: Join, turn: int) -> DataFrame:
    """Nodes outside the largest component of their shingles, with pivots inside it.

    ``entries``: token, node, weight, size, need, root, members; ``now``: as of ``_now``. A node takes the
    component that most of its shingles offer, and ``join.pivots`` to the power of ``turn`` nodes of
    it by hash, so that fewer and fewer nodes are tried against more and more pivots.
    """
    largest = F.max(F.struct("members", F.xxhash64("root", F.lit(turn)), "root")).alias("largest")
    offers = entries.groupBy("token").agg(largest, F.min("root").alias("low"), F.max("root").alias("high"))
    offers = offers.where("low <> high").select("token", F.col("largest.root").alias("other"))
    met = entries.join(offers, "token").where(F.col("root") != F.col("other"))
    votes = met.groupBy("node", "other").agg(F.sum("weight").alias("votes"), *[F.min(c).alias(c) for c in ("size", "need")])
    # only some of the shingles a node shares with a component offer that one
    votes = votes.where(F.col("votes") * 2 >= F.col("need"))
    best = votes.groupBy("node", "size").agg(F.max_by("other", F.struct("votes", "other")).alias("root"))
    order = Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    pivots = now.select("root", F.col("node").alias("b"), F.col("size").alias("b_size"), F.row_number().over(order).alias("rank"))
    pivots = pivots.where(F.col("rank") <= join.pivots**turn)
    pairs = best.join(pivots, "root").where(_fits("size", "b_size", join.percent))
    return pairs.select(F.col("node").alias("a"), "b")


def _candidates(entries: DataFrame, percent: int, block: int | None = None) -> DataFrame:
    """Pairs of nodes in different components whose prefixes share as many shingles as they must.

    ``entries``: token, node, place (of the token in the node's order, from 0), root, size, need, and
    weight, if a token stands for several shingles of the same nodes: their number; place is the first one's.
    A similar pair has its first common token in both prefixes, and all others behind it: nodes meet
    by a token only if what is left from there on, in either node, is as much as the least overlap. Of
    the pairs that meet, those remain that share enough tokens. With ``block``, all such pairs, whatever
    their components; root is not read, and a token's nodes are paired by blocks of about so many, by
    each of the first common tokens that are asked for, the k-th of which may leave k - 1 less.
    """
    if "weight" not in entries.columns:
        entries = entries.withColumn("weight", F.lit(1))
    if block:
        blocks = F.ceil(F.count("*") / block).cast("int").alias("blocks")
        entries = entries.join(entries.groupBy("token").agg(blocks), "token")
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        first = entries.withColumn("x", own).withColumn("y", every)
        second = entries.withColumn("y", own).withColumn("x", every)
        on, names = ["token", "x", "y"], ("node", "place", "size", "need")
    else:
        first = second = entries.join(_several(entries), "token", "left_semi")
        on, names = ["token"], ("node", "place", "root", "size", "need")
    other = second.select(*on, *[F.col(c).alias(f"other_{c}") for c in names])
    rest = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    earlier = F.least("need", "other_need") - 1 if block else F.lit(0)
    met = first.join(other, on).where(
        (F.col("node") < F.col("other_node"))
        & (F.lit(True) if block else F.col("root") != F.col("other_root"))
        & _fits("size", "other_size", percent)
        & ((rest + earlier) * (100 + percent) >= (F.col("size") + F.col("other_size")) * percent)
    )
    pairs = met.groupBy(F.col("node").alias("a"), F.col("other_node").alias("b")).agg(
        F.sum("weight").alias("shared"), F.min(F.least("need", "other_need")).alias("need")
    )
    if not block:
        held = first.groupBy("node").agg(F.collect_list(F.struct("token", "weight")).alias("tokens"))
        pairs = pairs.join(held.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
        pairs = pairs.join(held.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
        common = F.filter("x", lambda own: F.array_contains(F.col("y.token"), own.token))
        pairs = pairs.withColumn("shared", F.aggregate(common, F.lit(0).cast("long"), lambda n, own: n + own.weight))
    return pairs.where("shared >= need")


def _possible(entries: DataFrame) -> DataFrame:
    """Nodes that hold as many shared shingles as they or one they share one with must share."""
    least = entries.groupBy("token").agg(F.min("need").alias("need"))
    own = entries.drop("need").join(least, "token").groupBy("node").agg(F.sum("weight").alias("shared"), F.min("need").alias("need"))
    return own.where("shared >= need").select("node")


def _now(facts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """node, size, need, root and the number of nodes of that root."""
    if roots is None:
        return facts.select("node", "size", "need", F.col("node").alias("root"), F.lit(1).cast("long").alias("members"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("members"))
    own = facts.select("node", "size", "need").join(roots, "node", "left")
    own = own.withColumn("root", F.coalesce("root", "node")).join(sizes, "root", "left")
    return own.select("node", "size", "need", "root", F.coalesce("members", F.lit(1).cast("long")).alias("members"))


def _rooted_entries(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The entries with the root of each node and the number of nodes of that root, which they may have had."""
    entries = entries.drop("root", "members")
    if roots is None:
        return entries.withColumns({"root": F.col("node"), "members": F.lit(1).cast("long")})
    sizes = roots.groupBy("root").agg(F.count("*").alias("members"))
    entries = entries.join(roots.join(sizes, "root"), "node", "left")
    return entries.withColumns({"root": F.coalesce("root", "node"), "members": F.coalesce("members", F.lit(1).cast("long"))})


def _components(entries: DataFrame, facts: DataFrame, rows: DataFrame, join: Join) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, root) and the verified pairs (a, b) that make the components; None without any."""
    links = roots = None

    def add(pairs: DataFrame) -> bool:
        nonlocal links, roots
        pairs = written(pairs.select("a", "b"))
        if pairs.isEmpty():
            return False
        found = written(_verified(pairs, rows, facts, join))
        if found.isEmpty():
            return False
        links = found if links is None else links.unionAll(found)
        roots = written(components(links))
        return True

    dense = entries.where(F.col("nodes") > join.dense)
    last = None
    for turn in range(join.pivot_rounds):
        now = _now(facts, roots)
        if roots is None:
            dense = _rooted_entries(dense, roots)
        else:
            # tokens of one component stay so
            dense, path = stored(_rooted_entries(dense.join(_several(dense), "token", "left_semi"), roots))
            if last:
                removed(rows.sparkSession, last)
            last = path
        add(_pivot_pairs(dense, now, join, turn))
    if join.pivot_rounds:
        dense = dense.join(_several(dense), "token", "left_semi")
    entries = entries.where(F.col("nodes") <= join.dense).unionByName(dense.select(entries.columns))
    entries, path = stored(_rooted_entries(entries, roots))
    add(_candidates(entries, join.percent))
    for done in filter(None, (last, path)):
        removed(rows.sparkSession, done)
    return roots, links


def _tokens(entries: DataFrame, join: Join) -> DataFrame:
    """token, node, place, weight, nodes, size, need of the ``entries`` (node, size, need, place, entry)
    that several nodes have, or may have.

    Entries of the same nodes are one token: they tell the same of any two nodes, and the nodes meet by
    the first of them. If hashes of different sets of nodes agree, more nodes meet, and no pair is lost.
    """
    group = Window.partitionBy("entry")
    entries = entries.withColumns({"low": F.min("node").over(group), "high": F.max("node").over(group)})
    entries = entries.withColumns({"nodes": F.count("*").over(group), "sum": F.sum(F.xxhash64("node").cast("decimal(20,0)")).over(group)})
    # a shingle of one node finds nothing; those of many nodes are dealt to several groups
    frequent = F.col("entry").bitwiseAND(F.lit(_SALTS)) > 0
    entries = entries.where((F.col("low") != F.col("high")) | frequent)
    token = F.when(frequent, F.col("entry").bitwiseAND(F.lit(~_SALTS))).otherwise(F.xxhash64("nodes", "low", "high", "sum"))
    nodes = F.when(frequent, F.lit(join.salt_over).cast("long")).otherwise(F.col("nodes"))
    return entries.groupBy(token.alias("token"), "node").agg(
        F.min("place").alias("place"),
        F.count("*").alias("weight"),
        F.max(nodes).alias("nodes"),
        *[F.min(c).alias(c) for c in ("size", "need")],
    )


def _prepared(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents with their nodes; prefix entries and facts of the nodes that may be linked; texts."""
    context = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")

    def shingles(batch):
        return (keys for _, keys in shingle_sets(batch.column("text"), join.words))

    frequency = Frequency(tallied(rows.select("text"), shingles, join.counters))
    kind = dict(docs.dtypes)["doc_id"]
    members = written(
        rows.mapInArrow(
            _nodes(context.broadcast(frequency), join),
            f"doc_id {kind}, row long, n_shingles long, node long, need int, entries array<long>",
        )
    )
    some = members.where("node IS NOT NULL")
    facts = some.groupBy("node").agg(
        F.first("entries").alias("entries"), *[F.min(c).alias(c) for c in ("n_shingles", "need", "row")]
    )
    facts = facts.withColumnRenamed("n_shingles", "size")
    entries = _tokens(facts.select("node", "size", "need", F.posexplode("entries").alias("place", "entry")), join)
    entries = written(entries)
    facts = written(facts.drop("entries").join(_possible(entries), "node", "left_semi"))
    entries = written(entries.join(facts.select("node"), "node", "left_semi"))

    return members.drop("entries"), entries, facts, rows


def linked(docs: DataFrame, join: Join = JOIN) -> tuple[DataFrame, DataFrame]:
    """The documents with their nodes (doc_id, row, n_shingles, node), and every pair (a, b) of
    different nodes, a < b, whose sets are similar enough."""
    members, entries, facts, rows = _prepared(docs, join)
    pairs = written(_candidates(entries, join.percent, join.block).select("a", "b"))
    return members, written(_verified_in_blocks(pairs, rows, facts, join))


def _rooted(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, row, n_shingles, node and root of every row, null where the set is empty; verified pairs."""
    members, entries, facts, rows = _prepared(docs, join)
    roots, links = _components(entries, facts, rows, join)
    if roots is None:
        return members.withColumn("root", F.col("node")), None
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), links


def classes(docs: DataFrame, join: Join = JOIN) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own included. Texts that are
    null or without words have an empty set and are linked with nothing: their component is their
    doc_id. Texts of fewer words than a shingle are one shingle. Equal sets are always linked.
    Repeated rows are linked. A null doc_id is larger than all others. Further columns of ``docs``
    are ignored.
    """
    rows, _ = _rooted(docs, join)
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.coalesce("least", "doc_id").alias("component_id")
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", component)


def grouped(docs: DataFrame, join: Join = JOIN) -> DataFrame:
    """As ``classes``, and set_id, n_equal, linked_set: membership and verified pairs of sets.

    Equal sets are one: set_id is the smallest doc_id that has the row's set, n_equal the number of
    rows that have it, the row's own included. linked_set is the smallest set_id of another set that
    a verified pair joins with the row's set, null where no other set is similar; these pairs
    span every component. Rows with an empty set are a set of their own: set_id is the doc_id, n_equal 1.
    """
    rows, links = _rooted(docs, join)
    rows = written(rows.select("doc_id", "n_shingles", "node", "root"))
    some = rows.where("node IS NOT NULL")
    sets = written(some.groupBy("node", "root").agg(F.count("*").alias("n_equal"), F.min("doc_id").alias("set_id")))
    component = sets.groupBy("root").agg(F.min("set_id").alias("component"))
    facts = sets.join(component, "root").drop("root")
    if links is None:
        facts = facts.withColumn("linked_set", F.lit(None).cast(dict(docs.dtypes)["doc_id"]))
    else:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        other = both.join(sets.select(F.col("node").alias("b"), "set_id"), "b")
        other = other.groupBy(F.col("a").alias("node")).agg(F.min("set_id").alias("linked_set"))
        facts = facts.join(other, "node", "left")
    return rows.join(facts, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("set_id", "doc_id").alias("set_id"),
        F.coalesce("n_equal", F.lit(1).cast("long")).alias("n_equal"),
        "linked_set",
    )


def counted(docs: DataFrame, join: Join = JOIN) -> DataFrame:
    """As ``classes``, and n_links: how many other rows have a set similar enough, equal ones included."""
    members, links = linked(docs, join)
    held = written(members.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("held"), F.min("doc_id").alias("least")))
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(held.select(F.col("node").alias("b"), "held"), "b").groupBy(F.col("a").alias("node"))
    nodes = held.join(others.agg(F.sum("held").alias("others")), "node", "left").join(components(links), "node", "left")
    n_links = F.col("held") - 1 + F.coalesce("others", F.lit(0).cast("long"))
    nodes = written(nodes.select("node", F.coalesce("root", "node").alias("root"), "least", n_links.alias("n_links")))
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    nodes = nodes.drop("least").join(least, "root").select("node", "component", "n_links")
    return members.join(nodes, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def one_of_each(docs: DataFrame, join: Join = JOIN) -> DataFrame:
    """``docs`` with one row of each component, that of smallest doc_id, with the columns it had.

    Of rows equal in doc_id and text one stays. Rows whose set is empty all stay.
    """
    rows = _rooted(docs, join)[0].where("root IS NOT NULL").select("root", "doc_id", F.col("row").alias(ROW))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    first = rows.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("members"))
    first = first.where("members > 1").select("root", F.col(f"first.{ROW}").alias("kept"))
    groups = written(rows.join(first, "root").select(ROW, (F.col(ROW) == F.col("kept")).alias("stays")))
    docs = without(docs, groups.where("NOT stays"))
    again = groups.where("stays").groupBy(ROW).count().where("count > 1").select(ROW)
    if again.isEmpty():
        return docs
    again = written(again)
    same = docs.withColumn(ROW, row_key("doc_id", "text")).join(checked(again), ROW, "left_semi")
    return without(docs, again).unionByName(same.dropDuplicates([ROW]).drop(ROW))


def op4(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))
