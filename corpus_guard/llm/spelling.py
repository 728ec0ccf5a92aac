"""Spelling variants of the words of a corpus, by search schemes on a bidirectional FM-index.

Two words are near if one inserted, deleted or replaced code point makes them equal. Of the two halves
of a word, a near one holds the first as its start or the second as its end. So there are two searches:
match one half exactly, then go on over the other half and allow one error. A pair of FM-indexes serves
them, one over the delimited words and one over the delimited words turned round. As the delimiter
anchors each half at an end of the word, a search never has to turn: it takes its exact half first in
the index that begins there, and every step narrows an interval of suffix ranks.

Words are dealt to groups by their halves: a word asks in the group of its own half, and is indexed in
the groups of the halves of every word that may be near it (of one code point less, as many, or one
more). A group holds about ``block`` words; a half that more words share is dealt to a grid of groups,
in which each part of the asking words meets each part of the indexed ones. Every group sends one row
a word it was asked for, never the pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.llm import arrays
from corpus_guard.llm.shared import checked, removed, stored, table, written


@dataclass(frozen=True)
class Spelling:
    """``least_length``: code points, ``least_seen``: occurrences of a word; ``ratio``: how many times
    as frequent a form is; ``slip``: one in so many occurrences is taken to be misspelt (0: none);
    ``block``: indexed words of one group."""

    least_length: int = 6
    least_seen: int = 5
    ratio: int = 5
    slip: int = 199
    block: int = 50_000


SPELLING = Spelling()
#: Bytes of text in which words are made distinct, and words asked for in one go.
TEXT_BYTES = 1 << 22
ASKED = 1 << 13

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: The first byte of U+00C0 to U+00FF; the second one is any continuation byte.
_LEAD = 0xC3


def _letters(part: np.ndarray) -> np.ndarray:
    lead = part == _LEAD
    solid = _LETTER[part] | lead
    solid[1:] |= lead[:-1]
    return solid


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of bytes part[starts[i]:ends[i]], each behind bytes whose crc32 is before[i]."""
    order = np.argsort(starts - ends, kind="stable")
    left = (ends - starts)[order]
    place, state = starts[order], before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for i in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -i, "left"))  # those longer than i come first
        state[:n] = _CRC[(state[:n] ^ part[place[:n] + i]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    result = np.empty_like(state)
    result[order] = state ^ np.uint32(0xFFFFFFFF)
    return result


def _occurrences(spelling: Spelling):
    def batch_of(words: list[pa.Array], seen: list[np.ndarray]):
        return pa.RecordBatch.from_arrays([pa.concat_arrays(words), pa.array(np.concatenate(seen))], ["word", "n"])

    def run(batches):
        for batch in batches:
            data, offsets = arrays.text_bytes(batch.column("text"))
            prefix = [zlib.crc32(f"{x}:".encode()) for x in batch.column("id").to_pylist()]
            prefix = np.array(prefix, np.uint32)
            for first, last in arrays.blocks(offsets, TEXT_BYTES):
                part = arrays.LOWER[data[offsets[first] : offsets[last]]]
                starts, ends, owner = arrays.spans(_letters(part), offsets[first : last + 1] - offsets[first])
                if not len(starts):
                    continue
                leads = np.concatenate([[0], np.cumsum(part == _LEAD)])
                length = ends - starts - (leads[ends] - leads[starts])
                kept, slipped = length >= spelling.least_length, Counter()
                if spelling.slip:
                    numbers = crc32(part, starts, ends, prefix[first + owner])
                    slips = numbers % np.uint32(spelling.slip) == 0
                    kept &= ~slips
                    for i in np.flatnonzero(slips & (length > spelling.least_length)):
                        word, at = bytes(part[starts[i] : ends[i]]).decode(), int(numbers[i]) % int(length[i])
                        slipped[word[:at] + word[at + 1 :]] += 1
                starts, ends = starts[kept], ends[kept]
                _, place, seen = np.unique(arrays.word_hashes(part, starts, ends), return_index=True, return_counts=True)
                flat, cuts = arrays.gathered(part, starts[place], ends[place])
                buffers = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)]
                words = [pa.Array.from_buffers(pa.string(), len(place), buffers)]
                yield batch_of([*words, pa.array(list(slipped), pa.string())], [seen, np.array(list(slipped.values()), np.int64)])

    return run


def occurring(docs: DataFrame, spelling: Spelling = SPELLING) -> DataFrame:
    """word and n of all words of enough code points that occur often enough.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only. Where the crc32 of
    '<doc_id>:<word>' is divisible by ``slip``, the occurrence lacks the code point that the crc32
    names. A null doc_id is the empty text; null and empty texts have no words.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    words = rows.mapInArrow(_occurrences(spelling), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= spelling.least_seen)


class Index:
    """An FM-index over delimited words: rows are the suffixes of all words by rank.

    Codes of letters are 1, 2, ...; 0 is the delimiter. The delimiter behind word k is the k-th
    smallest, so all suffixes differ, and those of equal letters follow each other.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        """Word k is the code points flat[offsets[k]:offsets[k + 1]]; all words differ."""
        sizes = np.diff(offsets)
        count = len(sizes)
        self.letters, codes = np.unique(flat, return_inverse=True)
        size = len(flat) + count
        self.closes = np.cumsum(sizes + 1) - 1
        text = np.zeros(size, np.int64)
        inner = np.ones(size, bool)
        inner[self.closes] = False
        text[inner] = codes + 1
        rank = np.where(inner, count + text, np.cumsum(~inner) - 1)
        step = 1
        while step <= int(sizes.max()):
            behind = np.zeros(size, np.int64)
            behind[:-step] = rank[step:] + 1
            # suffixes told apart stay so; a delimiter's rank tells all it is a part of apart
            rank = np.unique(rank * (2 * size + 2) + behind, return_inverse=True)[1]
            step *= 2
        self.size = size
        self.suffix = np.empty(size, np.int64)
        self.suffix[rank] = np.arange(size)
        before = text[self.suffix - 1]
        # row numbers by the letter before: where a letter and a row meet is the row one step to the left
        self.steps = np.sort(before * (size + 1) + np.arange(size))

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Codes of code points; one that no word holds gets a code without rows."""
        place = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[place] == points, place + 1, len(self.letters) + 1)

    def left(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes of [low, high) with one more letter in front."""
        at = code * (self.size + 1)
        return np.searchsorted(self.steps, at + low), np.searchsorted(self.steps, at + high)

    def words(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which intervals hold a whole word, and the number of that word."""
        first, last = self.left(np.zeros(len(low), np.int64), low, high)
        whole = first < last
        row = self.steps[first[whole]]  # the delimiter's code is 0
        return whole, np.searchsorted(self.closes, self.suffix[row])

    def near(self, points: np.ndarray, offsets: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word asked, word found) for all words one error away whose last ``exact`` letters are the same."""
        codes, sizes = self.coded(points), np.diff(offsets)
        every = np.arange(1, len(self.letters) + 1)
        asked = np.arange(len(sizes))
        # states are (word asked, low, high), by the letters of it that are used up
        clean = (asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(self.closes)))
        off = tuple(np.zeros(0, np.int64) for _ in range(3))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for used in range(int(sizes.max(initial=0)) + 1):
            word, low, high = clean
            free = exact[word] <= used
            wide, a, b = word[free], low[free], high[free]
            child_low, child_high = self.left(every[None, :], a[:, None], b[:, None])
            some = child_low < child_high
            row, code = np.nonzero(some)
            child = (wide[row], child_low[some], child_high[some])
            off = tuple(np.concatenate(x) for x in zip(off, child))  # the found word has one letter more

            done = sizes[off[0]] == used
            whole, number = self.words(off[1][done], off[2][done])
            found.append((off[0][done][whole], number))

            following = codes[np.minimum(offsets[1:] - 1 - used, len(codes) - 1)] if len(codes) else codes
            off = self._followed(tuple(x[~done] for x in off), following)
            more = sizes[wide] > used
            lacks = (wide[more], a[more], b[more])  # it has one letter less
            turned = (sizes[child[0]] > used) & (following[child[0]] != every[code])  # it has another letter
            off = tuple(np.concatenate(x) for x in zip(off, lacks, tuple(x[turned] for x in child)))
            going = sizes[word] > used
            clean = self._followed(tuple(x[going] for x in clean), following)
        pairs = np.unique(np.concatenate([p * len(self.closes) + n for p, n in found]))
        return pairs // len(self.closes), pairs % len(self.closes)

    def _followed(self, states: tuple, following: np.ndarray) -> tuple:
        low, high = self.left(following[states[0]], *states[1:])
        alive = low < high
        return states[0][alive], low[alive], high[alive]


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


_FOUND = "word string, n long, n_near long, best_n long, best string"


def _answered(group: pa.Table) -> pa.Table:
    """For the rows of one group: what each asking word finds among the indexed ones."""
    start = bool(group.column("start")[0].as_py())
    asks = np.asarray(group.column("asks"), bool)
    seen = np.asarray(group.column("n"), np.int64)
    word = np.asarray(group.column("word").to_pylist(), object)
    asked, indexed = sorted(zip(word[asks], seen[asks])), sorted(zip(word[~asks], seen[~asks]))
    near, best = np.zeros(len(asked), np.int64), np.full(len(asked), -1, np.int64)
    names, often = [w for w, _ in indexed], np.array([n for _, n in indexed], np.int64)
    if asked and indexed:
        # an index of turned words begins where words start
        turn = (lambda w: w[::-1]) if start else (lambda w: w)
        index = Index(*_points([turn(w) for w in names]))
        for at in range(0, len(asked), ASKED):
            own = [w for w, _ in asked[at : at + ASKED]]
            flat, offsets = _points([turn(w) for w in own])
            sizes = np.diff(offsets)
            exact = sizes // 2 if start else sizes - sizes // 2
            ask, number = index.near(flat, offsets, exact)
            if not start:
                # those that hold the first half too are found by the other search
                other = [not names[n].startswith(own[a][: len(own[a]) // 2]) for a, n in zip(ask, number)]
                ask, number = ask[other], number[other]
            near[at : at + len(own)] = np.bincount(ask, minlength=len(own))
            order = np.lexsort((number, -often[number], ask))  # numbers follow the words' order
            ask, number = ask[order], number[order]
            new = np.flatnonzero(np.diff(ask, prepend=-1))
            best[at + ask[new]] = number[new]
    return pa.table(
        {
            "word": pa.array([w for w, _ in asked], pa.string()),
            "n": pa.array([int(n) for _, n in asked], pa.int64()),
            "n_near": pa.array(near),
            "best_n": pa.array([int(often[b]) if b >= 0 else None for b in best], pa.int64()),
            "best": pa.array([names[b] if b >= 0 else None for b in best], pa.string()),
        }
    )


def near_words(words: DataFrame, block: int = SPELLING.block) -> DataFrame:
    """word, n, n_near and the near word of largest n (best, best_n; of equals the first by code points).

    ``words``: word, n; each word once. Null words and words of one code point are left out: they
    have no halves. best is null where no word is near.
    """
    words = words.where(F.length("word") > 1)
    size = F.length("word")
    half, rest = (F.floor(x / 2).cast("int") for x in (size, size + 1))

    def key(length):
        return (F.col("start"), F.when(F.col("start"), F.substring("word", F.lit(1), length)).otherwise(F.right("word", length)).alias("half"))

    sides = words.withColumn("start", F.explode(F.array(F.lit(True), F.lit(False))))
    asking = sides.select("word", "n", F.lit(True).alias("asks"), *key(F.when(F.col("start"), half).otherwise(rest)))
    # halves of words of one code point less, as many, and one more
    lengths = F.when(
        F.col("start"), F.array(F.floor((size - 1) / 2), F.floor(size / 2), F.floor((size + 1) / 2))
    ).otherwise(F.array(F.floor(size / 2), F.floor((size + 1) / 2), F.floor((size + 2) / 2)))
    lengths = F.filter(F.array_distinct(lengths), lambda x: (x > 0) & (x <= size))
    indexed = sides.withColumn("length", F.explode(lengths))
    indexed = indexed.select("word", "n", F.lit(False).alias("asks"), *key(F.col("length").cast("int")))
    rows = asking.unionAll(indexed)

    sizes, path = stored(rows.groupBy("start", "half").agg(F.count_if(F.col("asks")).alias("asked"), F.count_if(~F.col("asks")).alias("held")))
    buckets = 1 + (sizes.agg(F.sum("held")).first()[0] or 0) // block
    grid = sizes.where((F.col("held") > block) | (F.col("asked") > block)).select(
        "start", "half", *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("asked", "held")]
    )
    rows = rows.join(checked(grid), ["start", "half"], "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce(F.when(F.col("asks"), F.col("asked")).otherwise(F.col("held")), F.lit(1)))
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.when(F.col("asks"), F.col("held")).otherwise(F.col("asked")), F.lit(1)) - 1))
    bucket = F.pmod(F.xxhash64("half"), F.lit(buckets))
    rows = rows.select("start", bucket.alias("bucket"), "word", "n", "asks", own.cast("int").alias("own"), every.alias("other"))
    x, y = (F.when(F.col("asks") == side, F.col("own")).otherwise(F.col("other")) for side in (True, False))
    rows = rows.select("start", "bucket", x.alias("x"), y.alias("y"), "word", "n", "asks")
    found = rows.groupBy("start", "bucket", "x", "y").applyInArrow(_answered, _FOUND)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    found = found.groupBy("word").agg(F.min("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    found = written(found.select("word", "n", "n_near", F.col("best.best").alias("best"), (-F.col("best.less")).alias("best_n")))
    removed(words.sparkSession, path)
    return found


def _last(links: DataFrame) -> DataFrame:
    """word and root for ``links`` (word, root), each root followed as far as links go; no circles."""
    spark = links.sparkSession
    links, path = stored(links)
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = links.join(further, "root", "left")
        if joined.where("further IS NOT NULL").isEmpty():
            return links
        links, new = stored(joined.select("word", F.coalesce("further", "root").alias("root")))
        removed(spark, path)
        path = new


def variants(docs: DataFrame, spelling: Spelling = SPELLING) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that ``occurring`` gives.

    A form is the near word of largest n, of equals the first by code points, if that n is at least
    ``ratio`` times the word's; else null. Root: where forms lead from the word, itself without one.
    Repeated rows count each time. An empty table gives no rows; further columns are ignored.
    """
    words = written(occurring(docs, spelling))
    found = near_words(words, spelling.block)
    often = F.col("best_n") >= spelling.ratio * F.col("n")
    found = found.select(
        "word", F.when(often, F.col("best")).alias("form"), "n", "n_near", F.when(often, F.col("best_n")).alias("form_n")
    )
    roots = _last(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    rows = found.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH crc AS MATERIALIZED (
    SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY k) AS steps
    FROM (SELECT unnest(range(256)) AS k)
), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(octet_length(encode(doc_id || ':' || run))),
            lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(steps[xor(c % 256, b) + 1], c // 256))) AS h
    FROM runs, crc
), words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % {SPELLING.slip} = 0
            THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
        FROM hashed)
    WHERE length(word) >= {SPELLING.least_length} GROUP BY word HAVING sum(n) >= {SPELLING.least_seen}
), less AS MATERIALIZED (
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), found AS MATERIALIZED (
    SELECT w.word, w.n, count(p.other) AS n_near,
        CASE WHEN max(p.n) >= {SPELLING.ratio} * w.n THEN list(p.other ORDER BY p.n DESC, p.other)[1] END AS form,
        CASE WHEN max(p.n) >= {SPELLING.ratio} * w.n THEN max(p.n) END AS form_n
    FROM words w LEFT JOIN pairs p ON w.word = p.word GROUP BY w.word, w.n
), followed AS (
    WITH RECURSIVE f(word, root) AS (
        SELECT word, word FROM found
        UNION ALL SELECT f.word, g.form FROM f JOIN found g ON f.root = g.word WHERE g.form IS NOT NULL
    ) SELECT f.word, f.root FROM f JOIN found g ON f.root = g.word WHERE g.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM found JOIN followed USING (word)
"""
