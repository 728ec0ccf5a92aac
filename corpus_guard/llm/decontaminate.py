"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII bytes, lower-cased. A document and a test item are
compared if they share a seed, a run of ``least_match`` words. Tiling repeatedly marks the longest
matches of words that are not marked yet, found by running Karp-Rabin hashing, so a test whose
sentences were put in another order is still covered. A document is contaminated by an item when
the tiles cover at least ``percent`` of the item's words. An item of fewer words than a seed is its own
seed: it contaminates the documents that consist of its words.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.llm import arrays
from corpus_guard.llm.jaccard import slots, tallied
from corpus_guard.llm.shared import ROW, row_key, table, without, written


@dataclass(frozen=True)
class Tiling:
    """``marks``: size in bits of the table that seeds are looked up in, the same for any input."""

    least_match: int = 5
    percent: int = 50
    first_length: int = 20
    marks: int = 1 << 22


TILING = Tiling()
#: Stands between runs of words; no word has this hash.
GAP = np.uint64(0)


def _windows(words: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``length`` free words, and their hashes."""
    count = len(words) - length + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[length:] == taken[:count])
    # rolling: h(i) = sum of words[i + k] * base ** (length - 1 - k), from prefix sums of the
    # words times falling powers; the base is odd, so the power can be taken out again
    power = np.full(len(words), arrays.INVERSE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count - 1, arrays.BASE, np.uint64)]))
    return starts, ((total[length:] - total[:count]) * back)[starts]


def _matches(test, text, free_test, free_text, length: int) -> list[tuple[int, int, int]]:
    """(length, start in test, start in text) of the maximal matches of at least ``length`` words."""
    starts, hashes = _windows(test, free_test, length)
    places = defaultdict(list)
    for at, value in zip(starts.tolist(), hashes.tolist()):
        places[value].append(at)
    starts, hashes = _windows(text, free_text, length)
    known = np.isin(hashes, np.fromiter(places, np.uint64, len(places)))
    found = []
    for j, value in zip(starts[known].tolist(), hashes[known].tolist()):
        for i in places[value]:
            if i and j and free_test[i - 1] and free_text[j - 1] and test[i - 1] == text[j - 1]:
                continue  # part of the match that starts before
            size = min(len(test) - i, len(text) - j)
            same = (test[i : i + size] == text[j : j + size]) & free_test[i : i + size]
            same &= free_text[j : j + size]
            size = size if same.all() else int(np.argmin(same))
            if size >= length:
                found.append((size, i, j))
    return found


def tiles(test: np.ndarray, text: np.ndarray, tiling: Tiling = TILING) -> list[tuple[int, int, int]]:
    """(length, start in test, start in text) of the tiles, longest first, then by place."""
    free_test, free_text = test != GAP, text != GAP
    length, marked = max(tiling.least_match, min(tiling.first_length, len(test))), []
    while True:
        found = _matches(test, text, free_test, free_text, length)
        longest = max(found, default=(0,))[0]
        if longest > 2 * length:
            length = longest
            continue
        new = False
        for size, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_test[i : i + size].all() and free_text[j : j + size].all():
                free_test[i : i + size] = free_text[j : j + size] = False
                marked.append((size, i, j))
                new = True
        if new:
            continue  # what is left of matches that lost words to longer ones
        if length == tiling.least_match:
            return marked
        length = max(length // 2, tiling.least_match)


def _word_blocks(column: pa.Array):
    """Hashes and text numbers of all words, block by block."""
    data, offsets = arrays.text_bytes(column)
    for first, last in arrays.blocks(offsets):
        part = arrays.LOWER[data[offsets[first] : offsets[last]]]
        spans = arrays.word_spans(part, offsets[first : last + 1] - offsets[first], arrays.NO_WORD)
        hashes = arrays.word_hashes(part, *spans[:2])
        hashes[hashes == GAP] = np.uint64(1)
        yield first, last, hashes, spans[2] + first


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.cumsum([0] + [len(v) for v in values]), pa.int32())
    return pa.ListArray.from_arrays(
        ends, pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64))
    )


def _whole(words: np.ndarray) -> np.ndarray:
    """The hash of all words in a row, of another family for each number of words; none for no words."""
    return arrays.grams(words, np.zeros(len(words), np.int8), len(words))[0] if len(words) else words


def _items(tiling: Tiling):
    def run(batches):
        for batch in batches:
            words, seeds = [], []
            for first, last, hashes, owner in _word_blocks(batch.column("text")):
                keys, text = arrays.grams(hashes, owner, tiling.least_match)
                for i in range(first, last):
                    words.append(hashes[owner == i])
                    short = len(words[-1]) < tiling.least_match
                    # repeats count, as they cover more
                    seeds.append(_whole(words[-1]) if short else keys[text == i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("item_id"), _lists(words), _lists(seeds)],
                ["item", "item_id", "words", "seeds"],
            )

    return run


def _suspects(marks, tiling: Tiling):
    """Of every text with a marked seed its runs of marked seeds, as words with gaps between."""
    least = tiling.least_match

    def marked(keys: np.ndarray) -> np.ndarray:
        at = slots(keys, tiling.marks)
        return ((marks.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)

    def run(batches):
        for batch in batches:
            kept, runs, seeds = [], [], []
            for first, last, hashes, owner in _word_blocks(batch.column("text")):
                counts = np.bincount(owner - first, minlength=last - first)
                starts = np.cumsum(counts) - counts
                for i in np.flatnonzero((counts > 0) & (counts < least)):
                    own = hashes[starts[i] : starts[i] + counts[i]]
                    key = _whole(own)
                    if marked(key)[0]:
                        kept.append(first + int(i))
                        runs.append(own)
                        seeds.append(key)
                if len(hashes) < least:
                    continue
                keys, _ = arrays.grams(hashes, np.zeros(len(hashes), np.int8), least)
                hit = marked(keys) & (owner[: len(keys)] == owner[least - 1 :])
                place = np.flatnonzero(hit)
                cuts = np.searchsorted(owner[place], np.arange(first, last + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    own = place[cuts[i] : cuts[i + 1]]
                    inside = np.unique((own[:, None] + np.arange(least)).ravel())
                    gaps = np.flatnonzero(np.diff(inside) > 1) + 1
                    kept.append(first + int(i))
                    runs.append(np.insert(hashes[inside], gaps, GAP))
                    seeds.append(np.unique(keys[own]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(kept, pa.int64())) for c in (ROW, "doc_id")] + [_lists(runs), _lists(seeds)],
                [ROW, "doc_id", "runs", "seeds"],
            )

    return run


def _tiled(tiling: Tiling):
    def run(batches):
        for batch in batches:
            covered, counts = [], []
            for test, text in zip(batch.column("words"), batch.column("runs")):
                test, text = (np.asarray(x.values).view(np.uint64) for x in (test, text))
                if len(test) < tiling.least_match:
                    found = [(len(test), 0, 0)] if np.array_equal(test, text) else []
                else:
                    found = tiles(test, text, tiling)
                covered.append(sum(size for size, _, _ in found))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (ROW, "doc_id", "item_id", "n_words")]
                + [pa.array(covered, pa.int64()), pa.array(counts, pa.int64())],
                [ROW, "doc_id", "item_id", "n_words", "covered", "n_tiles"],
            )

    return run


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, tiling: Tiling = TILING) -> DataFrame:
    """ROW, doc_id, item_id, n_words, covered and n_tiles of documents and items they contain.

    Null and empty texts and items match nothing. Items of fewer than ``least_match`` words match
    documents of the same words in the same order and no others. Rows of equal doc_id and text count
    once, as do equal items.
    """
    context = docs.sparkSession.sparkContext
    kind, doc_kind = dict(benchmark.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    items = benchmark.select(row_key("item_id", "text").alias("item"), "item_id", "text")
    items = written(
        items.dropDuplicates(["item"]).mapInArrow(
            _items(tiling), f"item long, item_id {kind}, words array<long>, seeds array<long>"
        )
    )
    seeds = items.select("item", F.size("words").alias("n_words"), F.explode("seeds").alias("seed"))

    def keys(batch):
        yield np.asarray(batch.column("seed")).view(np.uint64)

    marks = np.packbits(tallied(seeds.select("seed"), keys, tiling.marks) > 0)
    rows = docs.select(row_key("doc_id", "text").alias(ROW), "doc_id", "text")
    suspects = rows.mapInArrow(
        _suspects(context.broadcast(marks), tiling),
        f"{ROW} long, doc_id {doc_kind}, runs array<long>, seeds array<long>",
    )
    suspects = written(suspects.dropDuplicates([ROW]))
    shared = suspects.select(ROW, F.explode("seeds").alias("seed")).join(seeds, "seed")
    shared = shared.groupBy(ROW, "item").agg(F.count("*").alias("n_seeds"), F.max("n_words").alias("n_words"))
    # each place of a seed covers least_match words at most
    shared = shared.where(F.col("n_seeds") * tiling.least_match * 100 >= F.col("n_words") * tiling.percent)
    pairs = shared.select(ROW, "item", F.col("n_words").cast("long").alias("n_words"))
    pairs = pairs.join(items.select("item", "item_id", "words"), "item")
    pairs = pairs.join(suspects.select(ROW, "doc_id", "runs"), ROW)
    found = pairs.select(ROW, "doc_id", "item_id", "n_words", "words", "runs").mapInArrow(
        _tiled(tiling),
        f"{ROW} long, doc_id {doc_kind}, item_id {kind}, n_words long, covered long, n_tiles long",
    )
    return found.where(F.col("covered") * 100 >= F.col("n_words") * tiling.percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, tiling: Tiling = TILING) -> DataFrame:
    """doc_id, item_ids (sorted), coverage of the most covered item and n_tiles, by document.

    One row for each contaminated document; see ``contaminated_pairs``.
    """
    found = contaminated_pairs(docs, benchmark, tiling)
    return found.groupBy(ROW, "doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.max(F.col("covered") / F.col("n_words")).alias("coverage"),
        F.sum("n_tiles").alias("n_tiles"),
    ).drop(ROW)


def op5(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the contaminated rows, with the columns they had."""
    return without(docs, written(contaminated_pairs(docs, table(spark, sf_dir, "benchmark"))))
