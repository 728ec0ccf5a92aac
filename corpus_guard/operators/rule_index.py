"""Scans with a table of very many rules.

``operators.matching`` writes every rule into the plan, which suits a catalogue. Here the rules stay
data, and the plan has the same size for any number of them.

Rules that are one literal, alone of their id, take one pass over the units for some millions of them:

1. Literals are told from patterns by an expression. The driver gets the strings and sends out, of a few
   bytes each, what tells whether a stretch of text may be one of them (``Literals``).
2. Every place of a text is looked up by the hash of its first four bytes; where strings begin so, by that
   of eight, and so on. Places found give line, column and the string, which a join turns into its rules.

Other rules:

1. Each rule's required strings are told from its pattern (``functions.required``). Of the group that
   says most, every string gives the hash of its first bytes, ``WINDOW`` of them or all. The hashes lead
   back to rule ids: an inverted index, sent to all tasks.
2. Where four bytes of a folded text begin a string, the bytes from there are looked up by the lengths
   that strings with this beginning have, in one vectorised pass. So a rule is a candidate where its
   string is, not where a part of it is that many rules share. Rules without such a string are
   candidates of every unit. Units without candidates end here.
3. A unit gets its candidates' patterns, ``CHUNK`` bytes of text times ids in a row at most. Required
   strings are searched, then the patterns run, in the JVM, and findings are placed and de-duplicated
   inside the row; the text is folded and cut into lines once for all of them.

All rules of one of these ids are one candidate, as the first finding of an id on a line wins. Their index and
the rules are broadcast in blocks of ``BLOCK`` ids, each in one pass over the units; rules that no string
tells cost a pattern for each unit of their language, as they would in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_guard.catalogue.model import Rule
from corpus_guard.catalogue.names import SEVERITY_RANK, SUPPORTED_LANGUAGES
from corpus_guard.catalogue.package_rules import CATEGORIES
from corpus_guard.functions import text as tx
from corpus_guard.functions.dialect import to_java
from corpus_guard.functions.required import best, required
from corpus_guard.operators import matching
from corpus_guard.operators.findings import BRIEF, placed
from corpus_guard.operators.matching import KEY
from corpus_guard.plans.stage import kept
from corpus_guard.sources.rules import OWASP_SITE, rule_of

#: Rule ids whose rules and index are broadcast at a time.
BLOCK = 200_000
#: Bytes that begin a string, bytes of a string that are looked up at most, and of the texts in one go.
GRAM = 4
WINDOW = 32
TEXT_BYTES = 1 << 18
#: Bytes of a unit's text times the rule ids that one row of it runs: their marked texts are held at once.
CHUNK = 1 << 21
#: Bytes of a literal at most, and literals and bytes of them that are broadcast at a time.
LONGEST = 1 << 10
STRINGS = 1 << 23
STRING_BYTES = 1 << 28

#: Letters beyond ASCII that match an ASCII one when case is ignored.
_FOLDS = {"ſ": "s", "ı": "i", "İ": "i", "K": "k"}

_META = (
    "rule_id string, title string, severity string, category string, "
    "owasp struct<id:string,name:string,url:string>, description string, description_pt string, "
    "recommendation string, recommendation_pt string, fix_example string, confidence double, "
    "references array<string>, tags array<string>, detected_by string"
)
_PREPARED = f"{_META}, rank int, languages array<string>, pattern string, needs array<array<string>>, strings array<string>, at long"


def _prepare(frames):
    for frame in frames:
        rows = []
        for row in frame.to_dict("records"):
            given = {k: None if isinstance(v, float) and np.isnan(v) else v for k, v in row.items()}
            rule = rule_of({k: list(v) if isinstance(v, np.ndarray) else v for k, v in given.items()})
            if rule is None:
                continue
            groups = [g for g in required(rule.pattern) if min(map(len, g)) >= GRAM]
            rows.append(
                {
                    **{name: getattr(rule, name, None) for name in _META_NAMES},
                    "owasp": rule.owasp_id and {"id": rule.owasp_id, "name": rule.owasp_name or "", "url": rule.owasp_url or ""},
                    "references": list(rule.references),
                    "tags": list(rule.tags),
                    "rank": SEVERITY_RANK[rule.severity],
                    "languages": list(rule.languages or SUPPORTED_LANGUAGES),
                    "pattern": to_java(rule.pattern, rule.dotall),
                    "needs": [list(g) for g in groups],
                    "strings": list(best(groups)),
                    "at": given["at"],
                }
            )
        yield pd.DataFrame(rows, columns=[*_META_NAMES, "rank", "languages", "pattern", "needs", "strings", "at"])


_META_NAMES = (
    "rule_id title severity category owasp description description_pt recommendation recommendation_pt "
    "fix_example confidence references tags detected_by"
).split()


#: Printable ASCII that stands for itself in a pattern, alone or behind a backslash.
_PLAIN, _ESCAPED = r"[ -~&&[^\\^$.|?*+()\[\]{}]]", r"\\[ -~&&[^A-Za-z0-9]]"
_LITERAL = rf"\A{_PLAIN}*+(?:{_ESCAPED}{_PLAIN}*+)*+\z"


def _literal(rules: DataFrame) -> Column:
    """The string, in lower case, that is all a rule's pattern says; null for other patterns."""
    kind = F.coalesce(F.nullif(_given(rules, "pattern_type"), F.lit("")), F.lit("regex"))
    plain = F.octet_length("pattern").between(GRAM, 2 * LONGEST) & F.col("pattern").rlike(_LITERAL)
    known = F.col("id").isNotNull() & F.col("severity").isin(*SEVERITY_RANK) & (kind == "regex")
    string = F.lower(F.regexp_replace("pattern", r"\\(.)", "$1"))
    return F.when(plain, F.when(known & F.octet_length(string).between(GRAM, LONGEST), string))


def _given(rules: DataFrame, name: str, kind: str = "string") -> Column:
    return (F.col(name) if name in rules.columns else F.lit(None)).cast(kind)


def _literal_rules(rules: DataFrame) -> DataFrame:
    """What ``_prepare`` makes of rules with a ``literal``, as expressions."""
    texts = "description description_pt recommendation recommendation_pt fix_example".split()
    none = F.array().cast("array<string>")
    owasp = F.nullif(_given(rules, "owasp_id"), F.lit(""))
    owasp_name = F.coalesce(_given(rules, "owasp_name"), F.lit(""))
    url = F.concat(F.lit(f"{OWASP_SITE}#"), F.lower(owasp))
    language = F.nullif(_given(rules, "language"), F.lit(""))
    every = F.array(*[F.lit(x) for x in SUPPORTED_LANGUAGES])
    confidence = _given(rules, "confidence", "double")
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    made = {
        "rule_id": F.col("id"),
        "title": F.col("name"),
        "severity": F.col("severity"),
        "category": F.col("category"),
        "owasp": F.when(owasp.isNotNull(), F.struct(owasp.alias("id"), owasp_name.alias("name"), url.alias("url"))),
        **{name: F.coalesce(_given(rules, name), F.lit("")) for name in texts},
        "confidence": F.coalesce(F.nanvl(confidence, F.lit(None).cast("double")), F.lit(0.8)),
        "references": F.coalesce(_given(rules, "references", "array<string>"), none),
        "tags": F.coalesce(_given(rules, "tags", "array<string>"), none),
        "detected_by": F.lit(Rule.detected_by),
        "rank": rank[F.col("severity")],
        "languages": F.when(language.isNotNull(), F.array(language)).otherwise(every),
        "pattern": F.concat(F.lit(to_java("")), F.col("pattern")),
        "needs": F.array(F.array("literal")),
        "strings": F.array("literal"),
        "at": F.col("rule_no"),
    }
    return rules.select(*[column.alias(name) for name, column in made.items()], "literal")


def _ruled(rules: DataFrame, min_severity: str) -> DataFrame:
    """The rules of a table that run; ``literal`` where that string is all there is of a rule id."""
    numbered = placed(rules.withColumn("literal", _literal(rules)).orderBy("file", "at"), "rule_no").drop("file", "at")
    rows = _literal_rules(numbered.where("literal IS NOT NULL"))
    rest = numbered.where("literal IS NULL").drop("literal")
    if not rest.isEmpty():
        tasks = 2 * rules.sparkSession.sparkContext.defaultParallelism
        # patterns are read in so many tasks, however few parts the table has
        rest = rest.repartition(tasks, "rule_no").withColumnRenamed("rule_no", "at")
        rest = rest.mapInPandas(_prepare, _PREPARED).withColumn("literal", F.lit(None).cast("string"))
        rows = rows.unionByName(rest)
    runs = (F.col("rank") >= SEVERITY_RANK.get(min_severity, 0)) & F.col("category").isin(*CATEGORIES)
    own = Window.partitionBy("rule_id")
    rows = rows.withColumn("pattern_no", F.row_number().over(own.orderBy("at")) - 1)
    alone = F.sum(runs.cast("int")).over(own) == 1
    rows = rows.withColumn("literal", F.when(alone, F.col("literal"))).where(runs)
    return kept(rows.withColumn("at", F.col("at").cast("int")).withColumnRenamed("at", "rule_no"))


def _id_numbers(rows: DataFrame) -> DataFrame:
    """Rules that run with ``no``, the number of their id in the order of the ids' first rules."""
    first = rows.groupBy("rule_id").agg(F.min("rule_no").alias("first"))
    first = placed(first.orderBy("first"), "no").select("rule_id", F.col("no").cast("int").alias("no"))
    return rows.join(first, "rule_id")


def prepared(rules: DataFrame, min_severity: str = "low") -> DataFrame:
    """The rules of a table (``sources.rules.read_rules``) that run, numbered in the table's order.

    Rules of a category that no detector covers do not run, as in ``catalogue.package_rules``.

    rule_no, the metadata, rank, languages, the Java pattern, required strings (needs), those that the
    index takes (strings), ``literal``, and no: the number of the rule id, the same for all rules of an id.
    """
    return _id_numbers(_ruled(rules, min_severity))


# ------------------------------------------------------------------ index
def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, ASCII letters in lower case, and len + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    flat, ends = _flat(column)
    held = {head: bool((flat == head).any()) for head in {x.encode()[0] for x in _FOLDS}}
    rare = [x for x in _FOLDS if held[x.encode()[0]] and pc.any(pc.match_substring(column, x)).as_py()]
    for letter in rare:
        column = pc.replace_substring(column, letter, _FOLDS[letter])
    if rare:
        flat, ends = _flat(column)
    upper = (flat - np.uint8(65) < 26).view(np.uint8)
    return flat + (upper << np.uint8(5)), ends


def _flat(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


#: A number for each byte, and an odd factor with its inverse modulo 2 ** 64: the hash of n bytes is the sum of
#: their numbers times powers of the factor from 0, so that of any stretch follows from running totals.
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_FACTOR = 0x9E3779B97F4A7C15
_BACK = pow(_FACTOR, -1, 1 << 64)


def _powers(factor: int, count: int) -> np.ndarray:
    powers = np.full(count, factor, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def _gram_slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(12)


def _grams(data: np.ndarray) -> np.ndarray:
    """The number of the four bytes from every place on."""
    count = max(0, len(data) - GRAM + 1)
    grams = np.empty(count, np.uint32)
    for i in range(min(GRAM, count)):
        own = grams[i::GRAM]
        own[:] = data[i : i + GRAM * len(own)].view("<u4")
    return grams


def _grams_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The number of the four bytes from each of some places on."""
    grams = np.zeros(len(places), np.uint32)
    for i in range(GRAM):
        grams |= data[places + i].astype(np.uint32) << np.uint32(8 * i)
    return grams


class StringTable:
    """Numbers of strings, of which at most ``WINDOW`` bytes count, for all places of texts at once.

    ``keys``: sorted distinct hashes of the strings. Equal hashes of other bytes only make more candidates.
    """

    def __init__(self, strings: list[bytes]):
        strings = [w[:WINDOW] for w in strings]
        self.lengths = sorted({len(w) for w in strings})
        self.begins = np.zeros(1 << 20, np.uint32)
        data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(w) for w in strings], np.int64)
        first = np.cumsum(sizes) - sizes
        if len(strings):
            slots = _gram_slot(_grams(data)[first])
            np.bitwise_or.at(self.begins, slots, np.uint32(1) << (sizes - GRAM).astype(np.uint32))
        self.block = TEXT_BYTES
        self.back = _powers(_BACK, max(len(data), self.block + WINDOW))
        self.keys, self.of = np.unique(self._hashes(self._totals(data), first, sizes), return_inverse=True)
        self.back = self.back[: self.block + WINDOW].copy()
        self.marks = np.zeros(1 << 22, bool)
        self.marks[self._slot(self.keys)] = True

    @staticmethod
    def _totals(data: np.ndarray) -> np.ndarray:
        own = _BYTES[data] * _powers(_FACTOR, len(data))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(42)

    def _hashes(self, totals: np.ndarray, first: np.ndarray, sizes) -> np.ndarray:
        mixed = (totals[first + sizes] - totals[first]) * self.back[first] + np.asarray(sizes).astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """(text number, number of the key) of every known string within a text, block by block."""
        if not len(self.keys):
            return
        for at in range(0, max(0, len(data) - GRAM + 1), self.block):
            part = data[at : at + self.block + WINDOW - 1]
            lengths = self.begins[_gram_slot(_grams(part)[: self.block])]
            some = np.flatnonzero(lengths)
            lengths = lengths[some]
            owner = np.searchsorted(offsets, some + at, "right") - 1
            left = offsets[owner + 1] - at - some
            totals = self._totals(part)
            for size in self.lengths:
                own = np.flatnonzero((lengths >> np.uint32(size - GRAM)) & np.uint32(1))
                own = own[left[own] >= size]
                keys = self._hashes(totals, some[own], size)
                known = np.flatnonzero(self.marks[self._slot(keys)])
                own, keys = own[known], keys[known]
                found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                same = self.keys[found] == keys
                yield owner[own[same]], found[same]


class Index:
    """``table``: of strings; its key i leads to numbers[starts[i]:starts[i + 1]]; ``always``: ids of no string.

    ``rules``: of all ids, sorted; those of number n are rules[first[n]:first[n + 1]].
    """

    def __init__(self, pairs: list[tuple[bytes, int]], always: list[int], rules: pa.StructArray):
        self.table = StringTable([w for w, _ in pairs])
        numbers = np.array([n for _, n in pairs], np.int64)
        both = np.unique((self.table.of.astype(np.int64) << 32) | numbers)
        del self.table.of
        self.starts = np.searchsorted(both >> 32, np.arange(len(self.table.keys) + 1))
        self.numbers = (both & 0xFFFFFFFF).astype(np.int32)
        self.always = np.array(sorted(always), np.int32)
        held = rules.field("no").to_numpy()
        self.rules, self.first = rules, np.searchsorted(held, np.arange(held.max(initial=-1) + 2))


def indexed(rules: DataFrame) -> Index:
    """The index of one block of prepared rules, which the driver gets."""
    pairs = []
    always = set()
    block = rules.select(*_OWN, "strings").toArrow().combine_chunks().sort_by([("no", "ascending"), ("rule_no", "ascending")])
    for no, strings in zip(block.column("no").to_pylist(), block.column("strings").to_pylist()):
        if strings:
            pairs.extend((w.encode(), no) for w in strings)
        else:
            always.add(no)
    return Index(pairs, list(always), block.select(_OWN).to_struct_array().combine_chunks())


#: What a unit's row holds of a rule.
_OWN = ["no", "rule_no", "rank", "pattern", "needs", "languages"]
_OWN_SCHEMA = "no int, rule_no int, rank int, pattern string, needs array<array<string>>, languages array<string>"


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, in a row."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _candidates(index):
    def run(batches):
        own = index.value
        lookup = own.table
        for batch in batches:
            many = batch.num_rows
            keys = [np.repeat(np.arange(many, dtype=np.int64), len(own.always)) << 32]
            keys[0] |= np.tile(own.always, many).astype(np.int64)
            for unit, key in lookup.hits(*_folded(batch.column("text"))):
                pair = np.unique(unit * len(lookup.keys) + key)
                unit, key = pair // len(lookup.keys), pair % len(lookup.keys)
                sizes = own.starts[key + 1] - own.starts[key]
                at = _ranges(own.starts[key], sizes)
                keys.append((np.repeat(unit, sizes) << 32) | own.numbers[at].astype(np.int64))
            pairs = np.unique(np.concatenate(keys))
            unit, number = pairs >> 32, pairs & 0xFFFFFFFF
            # ids of one unit are dealt to rows, as many to each as its text allows
            sizes = np.bincount(unit, minlength=many)
            length = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            each = np.maximum(CHUNK // np.maximum(length, 1), 1)
            place = np.arange(len(pairs)) - (np.cumsum(sizes) - sizes)[unit]
            begins = np.flatnonzero(place % each[unit] == 0)
            held = own.first[number + 1] - own.first[number]
            ends = np.concatenate([[0], np.cumsum(held)])[np.append(begins, len(pairs))]
            rules = own.rules.take(pa.array(_ranges(own.first[number], held)))
            # a row weighs its text and its rules
            weight = np.cumsum(np.concatenate([[0], length[unit[begins]] + RULE_BYTES * np.diff(ends)]))
            parts = np.searchsorted(weight, np.arange(0, weight[-1] + PART, PART), "left")
            parts = np.unique(np.minimum(parts, len(begins)))
            for low, high in zip(parts[:-1], parts[1:]):
                lists = pa.array((ends[low : high + 1] - ends[low]).astype(np.int32))
                lists = pa.ListArray.from_arrays(lists, rules.slice(ends[low], ends[high] - ends[low]))
                yield batch.take(pa.array(unit[begins[low:high]])).append_column(_RULES, lists)

    return run


#: Bytes of a batch that goes to the JVM, and of a rule in it, about.
PART = 1 << 24
RULE_BYTES = 256
_RULES = "__rules"


# ------------------------------------------------------------------ literals
class Literals:
    """Places of very many strings in texts: some bytes a string, and the work a text grows little with them.

    A string is read by ``GRAM`` bytes. ``masks[n]``: by the hash of a beginning of n + 1 grams, which sizes below
    the next gram's end the strings with it have, and whether there are longer ones. ``bits``: of the hashes of
    whole strings. What is found may be another string with equal bits, so its bytes are compared with the rules' later.
    """

    def __init__(self, strings: pa.Array):
        data, offsets = _folded(strings)
        sizes, longest = np.diff(offsets), 0
        self.block, self.masks, whole = TEXT_BYTES, [], []
        self.sizes = frozenset(np.unique(sizes).tolist())
        first, hashes = offsets[:-1], None
        while len(sizes):
            # beginnings of one gram more, of the strings that have it
            longest += GRAM
            grams = _grams_at(data, first + longest - GRAM)
            hashes = grams.astype(np.uint64) if hashes is None else self._longer(hashes, grams)
            over = sizes - longest
            if not self.masks:
                table, slots = np.zeros(1 << 20, np.uint8), _gram_slot(grams).astype(np.int64)
            else:
                keys, of = np.unique(hashes, return_inverse=True)
                table = np.zeros(1 << max(10, (4 * len(keys)).bit_length()), np.uint8)
                slots = self._slot(keys, table)[of]
            np.bitwise_or.at(table, slots, np.uint8(1) << np.minimum(over, GRAM).astype(np.uint8))
            self.masks.append(table)
            ended = np.flatnonzero(over < GRAM)
            last = _grams_at(data, (first + sizes)[ended] - GRAM)
            whole.append(np.unique(self._whole(hashes[ended], last, sizes[ended])))
            more = np.flatnonzero(over >= GRAM)
            first, sizes, hashes = first[more], sizes[more], hashes[more]
        self.longest = longest + GRAM
        whole = np.concatenate(whole or [np.zeros(0, np.uint64)])
        self.bits = np.zeros(1 << max(10, (2 * len(whole)).bit_length()), np.uint8)
        for at in self._probes(whole):
            np.bitwise_or.at(self.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    @staticmethod
    def _longer(hashes: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(32))) * np.uint64(_FACTOR) + grams

    def _whole(self, hashes: np.ndarray, last: np.ndarray, size) -> np.ndarray:
        """The hash of a string of its last gram and size, and that of its full grams."""
        mixed = self._longer(self._longer(hashes, last), np.asarray(size).astype(np.uint64))
        return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    @staticmethod
    def _slot(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(65 - len(table).bit_length())).astype(np.int64)

    def _probes(self, hashes: np.ndarray):
        """The two bits of each hash."""
        shift = np.uint64(62 - len(self.bits).bit_length())
        yield (hashes >> shift).astype(np.int64)
        yield ((hashes * np.uint64(_FACTOR)) >> shift).astype(np.int64)

    def _marked(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes a string may have."""
        known = np.ones(len(hashes), bool)
        for at in self._probes(hashes):
            known &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) != 0
        return known

    def places(self, data: np.ndarray, offsets: np.ndarray):
        """(places, sizes) of the stretches of ``data`` within a text that are known strings, block by block."""
        data = np.concatenate([data, np.zeros(self.longest + GRAM, np.uint8)])
        for at in range(0, int(offsets[-1]) if self.masks else 0, self.block):
            low, high = np.searchsorted(offsets, (at, at + self.block), "right")
            stops = offsets[low : high + 1] - at
            many = int(min(self.block, stops[-1]))
            grams = _grams(data[at : at + many + self.longest + GRAM])
            masks = self.masks[0][_gram_slot(grams[:many])]
            some = np.flatnonzero(masks != 0)
            masks, hashes = masks[some], grams[some].astype(np.uint64)
            # where the text of a place ends
            stops = np.repeat(stops, np.diff(np.minimum(stops, many), prepend=0))
            for n, table in enumerate(self.masks):
                size = (n + 1) * GRAM
                if n:
                    hashes = self._longer(hashes, grams[some + (size - GRAM)])
                    masks = table[self._slot(hashes, table)]
                for extra in self.sizes & {*range(size, size + GRAM)}:
                    own = np.flatnonzero(masks & np.uint8(1 << (extra - size)))
                    own = own[stops[some[own]] - some[own] >= extra]
                    if len(own):
                        place = some[own]
                        place = place[self._marked(self._whole(hashes[own], grams[place + (extra - GRAM)], extra))]
                        yield place + at, np.full(len(place), extra)
                more = np.flatnonzero(masks >= 1 << GRAM)
                some, hashes = some[more], hashes[more]
                if not len(some):
                    break


def _stretches(sizes: np.ndarray, most: int):
    """(low, high) of neighbours that weigh about ``most`` together, or are one that weighs more."""
    total = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + most, "right")))
        yield low, high
        low = high


_HIT = pa.struct([("offset", pa.int32()), ("column", pa.int32()), ("__hit", pa.string())])
_LINES = "`__line` int, `__snippet` string, `__hits` array<struct<offset:int,column:int,__hit:string>>"


def _lines_hit(table):
    """One row per line that holds known strings: unit, line, snippet and the first place of each string."""

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for low, high in _stretches(sizes, PART // 4):
                yield from _lines_of(batch.slice(low, high - low), table.value)

    return run


def _lines_of(units: pa.RecordBatch, table: Literals):
    texts = units.column("text")
    data, offsets = _folded(texts)
    breaks = np.flatnonzero(data == 10)
    found, weight, most = [], 0, PART // 4
    for own, size in table.places(data, offsets):
        found.append((own, size))
        weight += int(size.sum())
        if weight > most:
            found = [_firsts(data, offsets, breaks, found)]
            weight = int(found[0][1].sum())
            most = max(most, 2 * weight)
    if not found:
        return
    place, size = _firsts(data, offsets, breaks, found)
    unit = np.searchsorted(offsets, place, "right") - 1
    before = np.searchsorted(breaks, place)
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(before) != 0) | (np.diff(unit) != 0)])[: len(place)])
    # where lines start, and the places in characters
    above = np.searchsorted(breaks, offsets[:-1])[unit]
    start = offsets[unit]
    inner = before > above
    start[inner] = breaks[before[inner] - 1] + 1
    wide = np.flatnonzero((data & 0xC0) == 0x80)

    def chars(low, high):
        return (high - low - np.searchsorted(wide, high) + np.searchsorted(wide, low)).astype(np.int32)

    columns = [chars(offsets[unit], place), chars(start, place)]
    hits = pa.StructArray.from_arrays([*map(pa.array, columns), _pieces(data, place, size)], fields=list(_HIT))
    line = (before - above + 1)[heads].astype(np.int32)
    ends = np.append(heads, len(place))
    snippets, weight = _snippets(texts, unit[heads], line)
    kept_columns = [n for n in units.schema.names if n != "text"]
    rows = units.select(kept_columns).take(pa.array(unit[heads]))
    for low, high in _stretches(weight, PART):
        lists = pa.array((ends[low : high + 1] - ends[low]).astype(np.int32))
        lists = pa.ListArray.from_arrays(lists, hits.slice(ends[low], ends[high] - ends[low]))
        made = [pa.array(line[low:high]), pa.array(snippets[low:high], pa.string()), lists]
        own = rows.slice(low, high - low)
        yield pa.RecordBatch.from_arrays([*own.columns, *made], [*kept_columns, "__line", "__snippet", "__hits"])


def _firsts(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray]:
    """Of places and sizes, those of the first place of each string on a line, by place."""
    place, size = (np.concatenate(x) for x in zip(*found))
    # grows with every line and text
    line = np.searchsorted(breaks, place) + np.searchsorted(offsets, place, "right")
    string = _pieces(data, place, size).dictionary_encode().indices.to_numpy()
    order = np.lexsort((place, string, line))
    again = (np.diff(string[order]) == 0) & (np.diff(line[order]) == 0)
    order = order[np.concatenate([[True], ~again])[: len(order)]]
    order = order[np.argsort(place[order], kind="stable")]
    return place[order], size[order]


def _pieces(data: np.ndarray, place: np.ndarray, size: np.ndarray) -> pa.Array:
    """The stretches as strings."""
    ends = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    pieces = pa.py_buffer(np.ascontiguousarray(data[_ranges(place, size)]))
    return pa.Array.from_buffers(pa.large_string(), len(place), [None, ends, pieces]).cast(pa.string())


def _snippets(texts: pa.Array, unit: np.ndarray, line: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The lines around a line of a unit, as ``functions.text.snippet`` has them, and their sizes."""
    found, last, lines = [], None, []
    for own, number in zip(unit.tolist(), line.tolist()):
        if own != last:
            last, lines = own, texts[own].as_py().splitlines()
        found.append("\n".join(lines[max(0, number - 2) : number + 1]))
    return found, np.fromiter(map(len, found), np.int64, len(found))


def match_literals(units: DataFrame, rules: DataFrame, columns: Sequence[str], keep: Sequence[str] = KEY) -> DataFrame:
    """Findings of rules that are one literal each, alone of their id, with ``columns`` of the rules.

    The literals' places are found in a pass over the units, of ``STRINGS`` of them at a time. Literals hold
    no line break, so matches on different lines never overlap and the first place on a line is the first
    match there. A join by the string itself tells the rules.
    """
    wanted = [*dict.fromkeys([*keep, "language", "text"])]
    own = units.select(*wanted).where("text IS NOT NULL").withColumnRenamed("language", "__language")
    if "language" in keep:
        own = own.withColumn("language", F.col("__language"))
    if "text" in keep:
        own = own.withColumn("__text", F.col("text"))
    lines = ", ".join(f"`{n}` {t}" for n, t in own.dtypes if n != "text")
    many, weight = rules.agg(F.count("literal"), F.sum(F.octet_length("literal"))).first()
    blocks = max(1, -(-many // STRINGS), -(-(weight or 0) // STRING_BYTES))
    found = None
    for block in range(blocks if many else 0):
        strings = rules.select("literal").where(F.pmod(F.xxhash64("literal"), F.lit(blocks)) == block)
        strings = strings.toArrow().column("literal").combine_chunks()
        table = units.sparkSession.sparkContext.broadcast(Literals(strings))
        part = own.mapInArrow(_lines_hit(table), f"{lines}, {_LINES}")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = own.selectExpr("*", *[f"CAST(NULL AS {x.split(' ', 1)[1]}) AS {x.split(' ', 1)[0]}" for x in _LINES.split(", ")]).where("false")
    kept_columns = [F.col("__text" if n == "text" else n).alias(n) for n in keep]
    found = found.select(*kept_columns, "__language", "__line", "__snippet", F.inline("__hits"))
    facts = rules.select(F.col("literal").alias("__literal"), "rule_no", F.col("languages").alias("__languages"), *columns)
    found = found.join(facts, F.col("__hit") == F.col("__literal")).where("array_contains(__languages, __language)")
    tool = F.lit(None).cast("string").alias("tool")
    named = [F.col("__line").alias("line"), "offset", "column", tool, F.col("__snippet").alias("code_snippet")]
    return found.select("rule_no", *keep, *named, *columns)


# ------------------------------------------------------------------ scan
def match_table(units: DataFrame, rules: DataFrame, min_severity: str = "low", keep: Sequence[str] = KEY) -> DataFrame:
    """Findings of prepared rules, shaped like ``matching.match_findings``: one per (unit, line, rule id)."""
    units = units.select(*dict.fromkeys([*keep, "path", "language", "text"])).where("text IS NOT NULL")
    most = rules.agg(F.max("no")).first()[0]
    found = None
    for first in range(0, 1 + (-1 if most is None else most), BLOCK):
        block = rules.where(F.col("no").between(first, first + BLOCK - 1))
        index = units.sparkSession.sparkContext.broadcast(indexed(block))
        schema = ", ".join(f"`{n}` {t}" for n, t in units.dtypes)
        rows = units.mapInArrow(_candidates(index), f"{schema}, {_RULES} array<struct<{_OWN_SCHEMA}>>")
        part = rows.withColumnRenamed(_RULES, "rules").select(*keep, F.inline(F.expr(_findings(min_severity))))
        found = part if found is None else found.unionAll(part)
    return _nothing(units, keep) if found is None else found


def _nothing(units: DataFrame, keep: Sequence[str]) -> DataFrame:
    kinds = {"line": "int", "rule_no": "int", "offset": "int", "column": "int", "tool": "string", "code_snippet": "string"}
    return units.where("false").select(*keep, *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])


def _findings(min_severity: str) -> str:
    """SQL for the findings of one unit and ``rules``, those of an id in a row."""
    live = (
        "filter(transform(rules, (r, i) -> named_struct('no', i, 'pattern', r.pattern, 'runs', "
        "array_contains(r.languages, language) AND "
        "forall(r.needs, g -> exists(g, w -> contains(folded, w))))), r -> r.runs)"
    )
    live = tx.let("folded", matching.folded("text"), live)
    return tx.let("live", live, f"IF(size(live) > 0, {_numbered(matching.findings_of('live', 'rules', min_severity))}, NULL)")


def _numbered(findings: str) -> str:
    return (
        f"transform({findings}, f -> named_struct('line', f.line, 'rule_no', get(rules, f.rule_no).rule_no, "
        "'offset', f.offset, 'column', f.column, 'tool', f.tool, 'code_snippet', f.code_snippet))"
    )


def scan_table(
    units: DataFrame,
    rules: DataFrame,
    min_severity: str = "low",
    languages: Sequence[str] = SUPPORTED_LANGUAGES,
    columns: Sequence[str] = BRIEF,
    keep: Sequence[str] = KEY,
) -> DataFrame:
    """Findings of all rules of a table, as ``plans.scan.scan`` gives them for rules in its plan.

    ``rules``: as of ``sources.rules.read_rules``. Null texts have no findings; without rules or units
    there are none.
    """
    ready = _ruled(rules, min_severity)
    units = units.where(F.col("language").isin(*languages))
    found = match_literals(units, ready.where("literal IS NOT NULL"), columns, keep)
    rest = ready.where("literal IS NULL")
    if rest.isEmpty():
        return found
    rest = kept(_id_numbers(rest))
    others = match_table(units, rest, min_severity, keep).join(rest.select("rule_no", *columns), "rule_no")
    return found.unionByName(others.select(*found.columns))
