"""Language-model scores by subword lattice likelihood.

A text is its words (lower-cased A-Z), each behind a mark, and one end. The pieces are those of an
existing public vocabulary that can stand in such a word, single bytes included, so that every word
can be spelled; none is added or merged. Every way to cut a marked word into pieces is a path through
its lattice, and the log-space forward recursion adds up the probabilities of all paths. As no piece
reaches over a mark, a text's log probability is the sum over its words and its end.

The vocabulary's scores are its order only, so they serve as a first weight (1 / rank). Passes of
expectation maximisation then fit the pieces' unigram probabilities: one distribution over those that
start a word, one over those that go on and the stop of a word. A word seen in training has one more
path, itself as a whole, weighted by its count less a discount; the discounts of all words are the
weight of spelling. So the pieces are fitted on distinct words, the ones that spelling is for:

    P(word) = (max(c - d, 0) + d (V + 1) lattice(word)) / (N + 2 d),  P(end) = (ends + d) / (N + 2 d)

These add up to one over all words and the end. Counts do not fit a broadcast: the frequent words (at
most ``FREQUENT``, by the choice of their threshold) are sent to all tasks, and the others meet the
documents by an equality join in which no key is frequent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.llm import arrays
from corpus_guard.llm.shared import remainder, table, written

#: A public subword vocabulary (sentencepiece), with byte pieces.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Passes of expectation maximisation.
PASSES = 4
#: What every piece counts beside its expected number, so that none is impossible.
SMOOTHING = 0.1
#: Pieces that a word is first taken to have behind its first one.
FIRST_PIECES = 3
#: A word is frequent if it is more than one in so many words of the corpus; so there are fewer.
FREQUENT = 1 << 18
#: Bytes of text in which words are made distinct, and bytes of distinct words in one lattice.
TEXT_BYTES = 1 << 22
LATTICE_BYTES = 1 << 20
_MARK = 32


def pieces(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """The pieces that a marked, lower-cased word can hold, and a first weight of each.

    Pieces with A-Z or with a mark behind their start cannot occur. A byte piece and a piece of the
    same byte are one. All 256 bytes but the blanks are pieces, and the mark alone.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, int] = {}
    size = model.get_piece_size()
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        if model.is_byte(i):
            piece, place = bytes([int(name[1:-1], 16)]), size
        else:
            piece, place = name.replace("▁", " ").encode(), 1 - int(model.get_score(i))
        inner = piece[1:] if piece.startswith(b" ") else piece
        if not any(arrays.SPACE[b] or 65 <= b <= 90 for b in inner):
            rank[piece] = min(max(place, 1), rank.get(piece, size))
    for b in range(256):
        if not arrays.SPACE[b] and not 65 <= b <= 90:
            rank.setdefault(bytes([b]), size)
    rank.setdefault(b" ", size)
    known = sorted(rank)
    return known, 1 / np.array([rank[p] for p in known], np.float64)


class Lattice:
    """All cuts of marked words into pieces."""

    def __init__(self, known: list[bytes]):
        self.known = known
        self.starts = np.array([piece[0] == _MARK for piece in known])
        step: dict[tuple[int, int], int] = {}
        ends = {}
        for number, piece in enumerate(known):
            node = 0
            for b in piece:
                node = step.setdefault((node, b), len(step) + 1)
            ends[node] = number
        self.step = np.full((len(step) + 1, 256), -1, np.int32)
        for (node, b), child in step.items():
            self.step[node, b] = child
        self.piece = np.full(len(step) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple]]:
        """Pieces in the marked words data[offsets[i]:offsets[i + 1]], by their end in the word.

        Entry t lists (start, end, piece) arrays of the pieces that end t bytes into a word, one
        for each length, by growing length; no two of one such list share an end.
        """
        own = np.repeat(offsets[:-1], np.diff(offsets))
        padded = np.append(data, np.uint8(_MARK))
        at = np.arange(len(data))
        node = self.step[0, data]
        longest = int(np.diff(offsets).max(initial=0))
        found: list[list[tuple]] = [[] for _ in range(longest + 1)]
        length = 1
        while True:
            alive = node >= 0
            at, node = at[alive], node[alive]
            if not len(at):
                return found
            piece = self.piece[node]
            whole = piece >= 0
            start, number = at[whole], piece[whole]
            offset = start - own[start] + length
            order = np.argsort(offset.astype(np.uint16) if longest < 1 << 16 else offset, kind="stable")
            start, number, offset = start[order], number[order], offset[order]
            cuts = np.flatnonzero(np.diff(offset, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(offset))):
                found[offset[a]].append((start[a:b], start[a:b] + length, number[a:b]))
            # what follows the last byte of a word is a mark, which no piece holds behind its start
            node = self.step[node, padded[at + length]]
            length += 1

    def forward(self, edges: list, size: int, first: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """alpha[e]: log probability of the word's bytes before e, for e behind the word's start."""
        alpha = np.full(size + 1, -np.inf)
        begins = np.zeros(size + 1, bool)
        begins[first] = True
        for step in edges:
            for start, end, number in step:
                before = np.where(begins[start], 0.0, alpha[start])
                # the end of a word is the start of the next one: only words of one end meet there
                alpha[end] = np.logaddexp(alpha[end], before + weight[number])
        return alpha

    def log_probabilities(self, data: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The natural log probability of every marked word; words of no bytes are not allowed."""
        result = np.zeros(len(offsets) - 1)
        for a, b in arrays.blocks(offsets, LATTICE_BYTES):
            part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            alpha = self.forward(self.edges(part, ends), len(part), ends[:-1], weight)
            result[a:b] = alpha[ends[1:]]
        return result

    def expected(self, data: np.ndarray, offsets: np.ndarray, seen: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected number of each piece over all cuts of words seen so often, and their log probability."""
        total, likelihood = np.zeros(len(self.known)), 0.0
        for a, b in arrays.blocks(offsets, LATTICE_BYTES):
            part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            edges = self.edges(part, ends)
            alpha = self.forward(edges, len(part), ends[:-1], weight)
            begins = np.zeros(len(part) + 1, bool)
            begins[ends[:-1]] = True
            closes = np.zeros(len(part) + 1, bool)
            closes[ends[1:]] = True
            whole = np.repeat(alpha[ends[1:]], np.diff(ends))
            times = np.repeat(seen[a:b], np.diff(ends))
            beta = np.full(len(part) + 1, -np.inf)
            # by falling start: a piece of length n that ends at t starts at t - n
            by_start: list[list[tuple]] = [[] for _ in range(len(edges))]
            for t, step in enumerate(edges):
                for edge in step:
                    by_start[t - int(edge[1][0] - edge[0][0])].append(edge)
            for step in reversed(by_start):
                for start, end, number in step:
                    after = np.where(closes[end], 0.0, beta[end]) + weight[number]
                    beta[start] = np.logaddexp(beta[start], after)
                    before = np.where(begins[start], 0.0, alpha[start])
                    share = np.exp(before + after - whole[start]) * times[start]
                    total += np.bincount(number, share, len(total))
            likelihood += float(alpha[ends[1:]] @ seen[a:b])
        return total, likelihood


@dataclass
class Model:
    """``known``: pieces, ``weight``: their natural log probabilities, ``stop``: that of a word's stop;
    ``words``: key, word, n, n_train of every word of the corpus; ``frequent``: keys of those with
    n over ``rare``, ``frequent_seen``: their training counts; ``tokens``, ``kinds``, ``ends``:
    training tokens, distinct ones and documents; ``discount``: d; ``likelihoods``: of the distinct
    training words before each pass."""

    known: list[bytes]
    weight: np.ndarray
    stop: float
    words: DataFrame
    frequent: np.ndarray
    frequent_seen: np.ndarray
    rare: int
    tokens: int
    kinds: int
    ends: int
    discount: float
    likelihoods: list[float]

    @property
    def spelling(self) -> float:
        """Natural log of the weight that spelling has beside counts."""
        return math.log(self.discount * (self.kinds - (self.ends > 0) + 1))

    @property
    def total(self) -> float:
        return math.log(self.tokens + 2 * self.discount)


def weighted(counts: np.ndarray, starts: np.ndarray, stops: float) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the stop, which shares with the pieces that go on."""
    on = counts[~starts].sum() + stops
    return np.log(counts / np.where(starts, counts[starts].sum(), on)), math.log(stops / on)


def _distinct(part: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Keys of the distinct words, one place of each, and the number of each word among them."""
    hashes = arrays.word_hashes(part, starts, ends)
    keys, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return keys, starts[first], ends[first], number


def _marked(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each behind a mark, in a row."""
    lengths = ends - starts + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(starts, lengths) - 1
    data = part[np.maximum(place, 0)]
    data[offsets[:-1]] = _MARK
    return data, offsets


def _texts(column: pa.Array):
    """Blocks of texts: first, last + 1, lower-cased bytes, and starts, ends, owners of their words."""
    data, offsets = arrays.text_bytes(column)
    for first, last in arrays.blocks(offsets, TEXT_BYTES):
        part = arrays.LOWER[data[offsets[first] : offsets[last]]]
        yield first, last, part, *arrays.word_spans(part, offsets[first : last + 1] - offsets[first])


def _count(batches):
    for batch in batches:
        train = np.asarray(batch.column("train"), np.int64)
        for first, _, part, starts, ends, owner in _texts(batch.column("text")):
            if not len(starts):
                continue
            keys, a, b, number = _distinct(part, starts, ends)
            seen = np.bincount(number, minlength=len(keys))
            own = np.bincount(number, train[first + owner], len(keys)).astype(np.int64)
            data, offsets = arrays.gathered(part, a, b)
            word = pa.Array.from_buffers(
                pa.binary(), len(keys), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
            )
            columns = [pa.array(keys.view(np.int64)), word, pa.array(seen), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "word", "n", "n_train"])


def counted_words(docs: DataFrame) -> DataFrame:
    """key, word, n and n_train (documents where ``train`` is true) of every distinct word."""
    rows = docs.select("text", "train").mapInArrow(_count, "key long, word binary, n long, n_train long")
    return rows.groupBy("key", "word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def _expectations(known: list[bytes], weight):
    def run(batches):
        lattice, total, likelihood = Lattice(known), np.zeros(len(known)), 0.0
        for batch in batches:
            data, offsets = arrays.text_bytes(batch.column("word"))
            data, offsets = _marked(data, offsets[:-1], offsets[1:])
            more, own = lattice.expected(data, offsets, np.ones(batch.num_rows), weight.value)
            total, likelihood = total + more, likelihood + own
        used = np.flatnonzero(total)
        # the log probability travels as piece -1
        columns = [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], likelihood))]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "expected"])

    return run


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, passes: int = PASSES, smoothing: float = SMOOTHING) -> Model:
    """A model of the documents whose crc32(doc_id) mod 7 is not 2; words are counted over all.

    Null and empty texts are an end alone. Without training words all pieces keep the weights of
    the vocabulary's order. The driver holds the pieces and the frequent words.
    """
    rows = docs.select("text", (remainder("doc_id", 7) != 2).alias("train"))
    ends = rows.where("train").count()
    words = written(counted_words(rows))
    seen = F.col("n_train")
    total = words.agg(
        F.sum("n").alias("n"),
        F.sum(seen).alias("train"),
        *[F.count_if(x).alias(c) for c, x in (("kinds", seen > 0), ("once", seen == 1), ("twice", seen == 2))],
    ).first()
    rare = (total.n or 0) // FREQUENT
    # more than one in FREQUENT of all words each: fewer than FREQUENT rows
    frequent = words.where(F.col("n") > rare).select("key", "n_train").toArrow()
    discount = total.once / (total.once + 2 * total.twice) if total.once else 0.5

    known, first = pieces(vocabulary)
    starts = Lattice(known).starts
    weight, stop = weighted(first, starts, first[~starts].sum() / FIRST_PIECES)
    train, likelihoods = words.where(seen > 0).select("word"), []
    for _ in range(passes if total.kinds else 0):
        shared = docs.sparkSession.sparkContext.broadcast(weight)
        sums = train.mapInArrow(_expectations(known, shared), "piece int, expected double")
        sums = sums.groupBy("piece").agg(F.sum("expected").alias("expected")).toArrow()
        piece, expected = np.asarray(sums.column("piece")), np.asarray(sums.column("expected"))
        likelihoods.append(float(expected[piece < 0].sum()) + total.kinds * stop)
        counts = np.full(len(known), smoothing)
        counts[piece[piece >= 0]] += expected[piece >= 0]
        weight, stop = weighted(counts, starts, total.kinds)
        shared.unpersist()
    return Model(
        known,
        weight,
        stop,
        words,
        np.asarray(frequent.column("key"), np.int64).view(np.uint64),
        np.asarray(frequent.column("n_train"), np.int64),
        rare,
        int(total.train or 0) + ends,
        total.kinds + (ends > 0),
        ends,
        min(max(discount, 0.05), 0.95),
        likelihoods,
    )


def _scores(model: Model):
    """Per text what the task can say alone, and the words whose counts it does not hold.

    ``rest``: their keys, ``times``: how often the text holds them, ``spelled``: the log weight of
    spelling them.
    """
    context = model.words.sparkSession.sparkContext
    shared = context.broadcast((model.known, model.weight, model.frequent, np.append(model.frequent_seen, 0)))
    spelling, total, discount = model.spelling + model.stop, model.total, model.discount

    def run(batches):
        known, weight, keys, counts = shared.value
        lattice, frequent = Lattice(known), arrays.KeyTable(keys)
        whole = np.log(np.maximum(counts - discount, 1e-300))
        whole[counts == 0] = -np.inf
        for batch in batches:
            size = batch.num_rows
            tokens, told = np.ones(size, np.int64), np.zeros(size, np.int64)
            score, base = np.zeros(size), np.zeros(size)
            rest: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]]
            rest_sizes = np.zeros(size, np.int64)
            for first, last, part, starts, ends, owner in _texts(batch.column("text")):
                if not len(starts):
                    continue
                distinct, a, b, number = _distinct(part, starts, ends)
                spelled = lattice.log_probabilities(*_marked(part, a, b), weight) + spelling
                place = frequent.find(distinct)
                held = place >= 0
                own, count = slice(first, last), last - first
                tokens[own] += np.bincount(owner, minlength=count)
                log = np.where(held, np.logaddexp(whole[place], spelled), 0.0)
                score[own] = np.bincount(owner, log[number], count)
                base[own] = np.bincount(owner, np.where(held, np.log10(counts[place] + 1.0), 0.0)[number], count)
                told[own] = np.bincount(owner, (held & (counts[place] > 0))[number], count)
                left = ~held[number]
                pair, times = np.unique(owner[left] * len(distinct) + number[left], return_counts=True)
                rest_sizes[own] = np.bincount(pair // len(distinct), minlength=count)
                pair %= len(distinct)
                for x, more in zip(rest, (distinct[pair].view(np.int64), times.astype(np.int32), spelled[pair])):
                    x.append(more)
            sizes = pa.array(np.concatenate([[0], np.cumsum(rest_sizes)]), pa.int32())
            columns = [
                *(batch.column(c) for c in ("doc_id", "held_out")),
                *(pa.array(x) for x in (tokens, told, score - tokens * total, base)),
                *(pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(x))) for x in rest),
            ]
            names = ["doc_id", "held_out", "n_tokens", "told", "told_score", "told_base", "rest", "times", "spelled"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    n_tokens counts words and the end, n_known those seen in training; base_score adds up
    log10((c + 1) / (N + V + 1)), score is the model's log10 probability. Null texts count as
    empty: the end alone. Repeated rows get the same; further columns are ignored. A null doc_id
    counts as the empty id. Words are told apart by 64-bit hashes.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, told long, told_score double, told_base double, "
        "rest array<long>, times array<int>, spelled array<double>"
    )
    rows = docs.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "text")
    # the number of a row is written with it, and so stays the same
    rows = written(rows.mapInArrow(_scores(model), schema).withColumn("row", F.monotonically_increasing_id()))
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "times", "spelled")).alias("x"))
    rest = rest.select("row", F.col("x.rest").alias("key"), "x.times", "x.spelled")
    seen = F.col("n_train")
    rare = model.words.where((F.col("n") <= model.rare) & (seen > 0)).select("key", "n_train")
    whole = F.log(seen - model.discount)
    log = F.when(seen.isNull(), F.col("spelled")).otherwise(
        F.greatest(whole, "spelled") + F.log1p(F.exp(-F.abs(whole - F.col("spelled"))))
    )
    sums = rest.join(rare, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * log).alias("rest_score"),
        F.sum(F.col("times") * F.log10(F.coalesce(seen, F.lit(0)) + 1)).alias("rest_base"),
        F.sum(F.when(seen.isNotNull(), F.col("times")).otherwise(0)).alias("rest_told"),
    )
    each = math.log10(model.tokens + model.kinds + 1)
    end, end_base = math.log(model.ends + model.discount), math.log10(model.ends + 1)
    none = F.lit(0.0)
    score = F.col("told_score") + F.coalesce("rest_score", none) + F.lit(end)
    base = F.col("told_base") + F.coalesce("rest_base", none) + F.lit(end_base) - F.col("n_tokens") * F.lit(each)
    known = F.col("told") + F.coalesce("rest_told", F.lit(0).cast("long")) + F.lit(int(model.ends > 0))
    return rows.drop("rest", "times", "spelled").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (score / F.lit(math.log(10))).alias("score"),
    )


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs))
