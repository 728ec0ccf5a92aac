"""Language identification by prediction by partial matching.

For every language a context tree holds how often each byte followed each context of up to
``ORDER`` bytes. The code length of a byte is that of the longest context in which it was seen,
plus the escapes (method C) from the longer contexts that exist: with n visits and d distinct
followers, a follower seen c times has probability c / (n + d) and an escape d / (n + d); below the
empty context all 256 bytes are alike. Statistics are frozen after the fit. Escapes do not exclude
the followers of the context left, so the lengths are exact for the coder without exclusion.

The language of a text is the one that codes it shortest; the score is its share when every
language weighs 2 ** (-bits / ``SMOOTH``), as bytes of one text are far from independent.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_guard.llm import arrays
from corpus_guard.llm.shared import checked, lottery, remainder, table, written

#: Longest context in bytes; a gram (context and byte) must fit 64 bits.
ORDER = 4
#: Labelled documents per language that the trees are made of, those of smallest hash of doc_id.
PER_LANGUAGE = 900
SMOOTH = 8.0
UNKNOWN = "und"
#: A column name that tables do not have.
LETTER = "__has_letter"
#: Bits of a byte that nothing is known of, and bits that a text's code may be longer than that: a few
#: unknown words of a short text cost so much.
PLAIN, DOUBT = 8.0, 64.0


@dataclass
class Sparse:
    """Rows of few columns: row i has columns[starts[i]:starts[i + 1]] and the values beside them."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``rows``, column and value of all entries of these rows."""
        first = self.starts[rows]
        sizes = self.starts[rows + 1] - first
        at = np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        return np.repeat(np.arange(len(rows)), sizes), self.columns[at], self.values[at]


def _sparse(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int) -> Sparse:
    order = np.lexsort((columns, rows))
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))])
    return Sparse(starts, columns[order].astype(np.int32), values[order].astype(np.float32))


@dataclass
class Trees:
    """Grams of each length in one numbering, and what they cost in the languages that hold them.

    ``cost``: bits of the last byte of a gram after the bytes before it, for languages that saw it;
    ``escape``: bits of leaving a gram as a context, for languages that saw something behind it.
    Others leave the context without cost. ``parent``: the gram without its first byte, ``context``:
    without its last one (-1 for single bytes). ``unseen``: bits of a byte below the empty context.
    Both tables hold one entry for each gram and language of the sample.
    """

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    cost: Sparse
    escape: Sparse
    parent: np.ndarray
    context: np.ndarray
    unseen: np.ndarray

    def __post_init__(self):
        self.firsts = np.cumsum([0] + [len(k) for k in self.keys])

    @cached_property
    def tables(self) -> list[arrays.KeyTable]:
        """Made where they are used: the driver neither holds nor sends them."""
        return [arrays.KeyTable(k) for k in self.keys]

    def bits(self, column: pa.Array) -> np.ndarray:
        """Code length of every text in every language."""
        data, offsets = arrays.text_bytes(column)
        total = np.zeros((len(column), len(self.languages)))
        step = max(1, 4 * arrays.BLOCK_BYTES // max(4, len(self.languages)))
        for at in range(0, len(data), step):
            # a block starts up to `order` bytes early, for the contexts of its first bytes
            early = max(0, at - self.order)
            part = arrays.LOWER[data[early : at + step]].astype(np.uint64)
            places = np.arange(early, early + len(part))
            owner = np.searchsorted(offsets, places, "right") - 1
            room = np.minimum(places - offsets[owner] + 1, self.order + 1)
            bits = self._bits(part, room)[at - early :]
            owner = owner[at - early :]
            new = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[new]] += np.add.reduceat(bits, new, axis=0)
        return total

    def _bits(self, part: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Bits of each byte of ``part``; ``room`` is the longest gram that fits its text there."""
        grams = [part]
        for n in range(1, self.order + 1):
            longer = grams[-1].copy()
            longer[n:] += part[: len(part) - n] << np.uint64(8 * n)
            grams.append(longer)
        longest = np.full(len(part), -1)
        left = np.arange(len(part))
        escapes = []
        for n in range(self.order + 1, 0, -1):
            fits = room[left] >= n
            at = left[fits]
            found = self.tables[n - 1].find(grams[n - 1][at])
            hit = found >= 0
            longest[at[hit]] = self.firsts[n - 1] + found[hit]
            miss = at[~hit]
            if n > 1 and len(miss):
                context = self.tables[n - 2].find(grams[n - 2][miss - 1])
                known = context >= 0
                escapes.append((miss[known], self.firsts[n - 2] + context[known]))
            left = np.concatenate([left[~fits], miss])
        costs, row = self._costs(longest[longest >= 0])
        bits = np.tile(self.unseen, (len(part), 1))
        bits[longest >= 0] = costs[row]
        for at, context in escapes:
            leave, row = self._leave(context)
            bits[at] += leave[row]
        return bits

    def _leave(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of leaving the distinct ones of ``contexts``, and which of them each is."""
        distinct, row = _distinct(contexts, self.firsts[-1])
        leave = np.zeros((len(distinct), len(self.languages)))
        place, column, value = self.escape.entries(distinct)
        leave[place, column] = value
        return leave, row

    def _costs(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the distinct ones of ``grams`` and of all their endings, and which each gram is.

        A language that did not see a gram leaves its context and pays for the shorter gram.
        """
        held = np.zeros(self.firsts[-1], bool)
        held[grams] = True
        for n in range(self.order + 1, 1, -1):
            own = slice(self.firsts[n - 1], self.firsts[n])
            held[self.parent[own][held[own]]] = True
        rows = np.flatnonzero(held)
        place = np.full(self.firsts[-1], -1, np.int32)
        place[rows] = np.arange(len(rows))
        costs = np.empty((len(rows), len(self.languages)))
        cuts = np.searchsorted(rows, self.firsts)
        for n in range(1, self.order + 2):
            own = rows[cuts[n - 1] : cuts[n]]
            if n == 1:
                part = np.tile(self.unseen, (len(own), 1))
            else:
                leave, row = self._leave(self.context[own])
                part = costs[place[self.parent[own]]] + leave[row]
            line, column, value = self.cost.entries(own)
            part[line, column] = value
            costs[cuts[n - 1] : cuts[n]] = part
        return costs, place[grams]

    def predicted(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of shortest code, the first of equals; its share; its bits."""
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column))
        bits = self.bits(column)
        best, least = bits.argmin(axis=1), bits.min(axis=1)
        share = 1 / np.exp2((least[:, None] - bits) / SMOOTH).sum(axis=1)
        return [self.languages[i] for i in best], share, least


def _gram_counts(order: int):
    """Grams of one text: nothing reaches over its ends."""

    def run(batches):
        for batch in batches:
            languages = np.asarray(batch.column("lang"))
            data, offsets = arrays.text_bytes(batch.column("text"))
            for first, last in arrays.blocks(offsets, 4 * arrays.BLOCK_BYTES):
                parts = []
                part = arrays.LOWER[data[offsets[first] : offsets[last]]].astype(np.uint64)
                owner = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1]))
                gram = part
                for n in range(1, order + 2):
                    if len(part) < n:
                        break
                    if n > 1:
                        gram = gram[1:] + (part[: len(part) - n + 1] << np.uint64(8 * (n - 1)))
                    whole = owner[n - 1 :] == owner[: len(part) - n + 1]
                    keys, text = gram[whole], owner[n - 1 :][whole]
                    for language in set(languages[first:last]):
                        own = keys[languages[text] == language]
                        parts.append((language, n, *np.unique(own, return_counts=True)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([x[0] for x in parts], [len(x[2]) for x in parts]), pa.int32()),
                        pa.array(np.repeat([x[1] for x in parts], [len(x[2]) for x in parts]), pa.int32()),
                        pa.array(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in parts)]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(0, np.int64), *(x[3] for x in parts)])),
                    ],
                    ["lang", "length", "gram", "seen"],
                )

    return run


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang, text) of at most ``per_language`` labelled training documents per language.

    Rows with crc32(doc_id) mod 5 = 0 or without lang are not used. Of repeated ids one row is used.
    """
    train = docs.where((remainder("doc_id", 5) != 0) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    ids = train.select("lang", "doc_id", lottery("doc_id").alias("number"))
    # as ``cutoff``: about twice the rows wanted of a language are ranked, or all
    rows = F.count("*")
    below = F.when(rows <= 4 * per_language, F.lit(1 << 32)).otherwise(F.floor(F.lit(2.0 * per_language * (1 << 32)) / rows))
    ids = ids.join(checked(ids.groupBy("lang").agg(below.alias("below"))), "lang").where(F.col("number") < F.col("below"))
    order = Window.partitionBy("lang").orderBy("number", "doc_id")
    ids = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    picked = checked(ids.select("doc_id", "lang").distinct())
    rows = train.join(picked, ["doc_id", "lang"])
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, order: int = ORDER, per_language: int = PER_LANGUAGE) -> Trees:
    """All languages and all grams of the sample; the driver gets a row for each gram and language."""
    rows = written(sample(docs, per_language).select("lang", "text"))
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    number = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))]) if names else None
    if number is None:
        return trees({c: [] for c in ("length", "gram", "lang", "seen")}, order, [])
    rows = rows.select(number[F.col("lang")].alias("lang"), "text")
    counts = rows.mapInArrow(_gram_counts(order), "lang int, length int, gram long, seen long")
    counts = counts.groupBy("length", "gram", "lang").agg(F.sum("seen").alias("seen"))
    return trees(counts.toArrow(), order, names)


def _distinct(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of numbers below ``size``, and which of them each number is."""
    held = np.zeros(size, bool)
    held[numbers] = True
    distinct = np.flatnonzero(held)
    place = np.cumsum(held, dtype=np.int32) - 1
    return distinct, place[numbers]


def trees(counts, order: int, languages: list[str] | None = None) -> Trees:
    """Counts (columns length, gram, lang, seen) of all grams, as costs.

    ``lang`` is a number among ``languages``, or a name if those are not given.
    """
    length, gram, seen = (np.asarray(counts[c], np.int64) for c in ("length", "gram", "seen"))
    if languages is None:
        languages, lang = np.unique(np.asarray(counts["lang"], object).astype(str), return_inverse=True)
        languages = languages.tolist()
    else:
        lang = np.asarray(counts["lang"], np.int64)
    keys, parents, contexts = [], [], []
    costs, escapes = [], []
    first = 0
    many = len(languages)
    unseen = np.full(many, 8.0)
    for n in range(1, order + 2):
        own = length == n
        distinct, place = np.unique(gram[own].view(np.uint64), return_inverse=True)
        times, name = seen[own], lang[own]
        if n == 1:
            context = np.zeros(len(distinct), np.int64)
            parents.append(np.full(len(distinct), -1))
            contexts.append(np.full(len(distinct), -1))
        else:
            context = np.searchsorted(keys[-1], distinct >> np.uint64(8))
            ending = np.searchsorted(keys[-1], distinct & np.uint64((1 << (8 * (n - 1))) - 1))
            parents.append(first - len(keys[-1]) + ending)
            contexts.append(first - len(keys[-1]) + context)
        visited, line = np.unique(context[place] * many + name, return_inverse=True)
        total = np.bincount(line, times, len(visited))
        kinds = np.bincount(line, minlength=len(visited))
        leave = -np.log2(kinds / (total + kinds))
        if n == 1:
            unseen[visited] += leave
        else:
            escapes.append((first - len(keys[-1]) + visited // many, visited % many, leave))
        costs.append((first + place, name, -np.log2(times / (total + kinds)[line])))
        keys.append(distinct)
        first += len(distinct)

    def table(parts):
        rows, columns, values = (np.concatenate([*x, []]) for x in zip(*parts)) if parts else ([], [], [])
        return _sparse(np.asarray(rows, np.int64), np.asarray(columns, np.int64), np.asarray(values), first)

    return Trees(
        languages, order, keys, table(costs), table(escapes), np.concatenate(parents), np.concatenate(contexts), unseen
    )


def _labelled(docs: DataFrame, model: Trees, schema: str, run) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(rows):
        for batch in rows:
            language, score, bits = shared.value.predicted(batch.column("text"))
            letters = np.asarray(batch.column(LETTER), bool)
            language = np.where(letters, np.asarray(language, object), UNKNOWN)
            yield run(batch, language, np.where(letters, score, 0.0), bits)

    # a null text has no letter
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(LETTER, letter).mapInArrow(batches, schema)


def identify(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``.

    A text that is null, empty or without letters is ``und`` with score 0, as is every text when
    no row had a language to learn. Of languages that code a text in equally many bits the first
    by name is taken. Repeated rows get the same. Further columns of ``docs`` are ignored.
    """

    def run(batch, language, score, bits):
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(language, pa.string()), pa.array(score, pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang_pred string, score double"
    result = _labelled(docs.select("doc_id", "text"), model, schema, run)
    return result.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows whose text some language codes about as short as plain bytes, with the columns they had.

    Texts without letters are rejected, and so is what reads like no language of the sample: its best
    code is more than ``DOUBT`` bits longer than ``PLAIN`` bits a byte. How much nearer the best
    language is than the others does not matter.
    """

    def run(batch, language, score, bits):
        sizes = np.diff(arrays.text_bytes(batch.column("text"))[1])
        known = (language != UNKNOWN) & (bits < PLAIN * sizes + DOUBT)
        return batch.filter(pa.array(known.astype(bool))).drop_columns([LETTER])

    return _labelled(docs, model, docs.schema, run)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def keep(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, fit(docs))
