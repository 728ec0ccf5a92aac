import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa

from corpus_guard.llm import language

STEMS = {
    "en": ["the", "that", "with", "hand", "thing", "other"],
    "de": ["der", "nicht", "schön", "über", "zeit", "und"],
    "fr": ["été", "que", "vous", "château", "dans", "pour"],
}


def _docs(count=300):
    draw = random.Random(3)
    for i in range(count):
        lang = draw.choice(list(STEMS))
        yield i, " ".join(draw.choice(STEMS[lang]) for _ in range(draw.randint(1, 40))), lang


def _brute_bits(texts, text, order):
    """Code length by dictionaries of contexts, byte by byte."""
    seen = defaultdict(Counter)
    for t in texts:
        data = t.lower().encode() if t.isascii() else language.arrays.LOWER[list(t.encode())].tobytes()
        for i, byte in enumerate(data):
            for n in range(min(order, i) + 1):
                seen[data[i - n : i]][byte] += 1
    total = 0.0
    data = language.arrays.LOWER[list(text.encode())].tobytes()
    for i, byte in enumerate(data):
        for n in range(min(order, i), -1, -1):
            counts = seen.get(data[i - n : i])
            if not counts:
                continue
            visits, kinds = sum(counts.values()), len(counts)
            if byte in counts:
                total -= math.log2(counts[byte] / (visits + kinds))
                break
            total -= math.log2(kinds / (visits + kinds))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    rows = list(_docs(60))
    texts = defaultdict(list)
    for _, text, lang in rows:
        texts[lang].append(text)
    counts = Counter()
    for lang, own in texts.items():
        for t in own:
            data = language.arrays.LOWER[list(t.encode())].tobytes()
            for i in range(len(data)):
                for n in range(1, min(i + 1, 4) + 1):
                    counts[n, int.from_bytes(data[i - n + 1 : i + 1]), lang] += 1
    frame = pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["length", "gram", "lang", "seen"])
    model = language.trees(frame, 3)
    probes = ["the other thing", "zeit ist üb", "xyz", "", "été", "q", "hand" * 5]
    bits = model.bits(pa.array(probes))
    want = [[_brute_bits(texts[lang], p, 3) for lang in model.languages] for p in probes]
    assert np.allclose(bits, want)


def test_blocks_do_not_change_code_lengths(monkeypatch):
    rows = list(_docs(40))
    frame = pd.DataFrame(
        [(1, b, "en", 3) for b in b"abcdeht "] + [(2, (97 << 8) | b, "en", 2) for b in b"bc "],
        columns=["length", "gram", "lang", "seen"],
    )
    model = language.trees(frame, 4)
    texts = pa.array([t for _, t, _ in rows])
    whole = model.bits(texts)
    monkeypatch.setattr(language.arrays, "BLOCK_BYTES", 7)
    assert np.allclose(whole, model.bits(texts))


def test_held_out_accuracy(documents):
    docs = documents(*_docs())
    got = language.identify(docs, language.fit(docs)).collect()
    truth = {i: lang for i, _, lang in _docs()}
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_odd_rows(documents):
    odd = [(1, None, "en"), (2, "", "de"), (3, "12 .;", "en"), (4, "the " * 90_000, "en"), (None, "der", None)]
    odd += [(6, "nicht", "de"), (6, "nicht", "de")]
    schema = "doc_id long, text string, lang string, score string, has_letter int"
    rows = [(100 + i, t, lang) for i, t, lang in _docs()]
    docs = documents(*odd, *rows, schema=schema, defaults=("en", "s", 0))
    model = language.fit(docs)
    got = defaultdict(list)
    for r in language.identify(docs, model).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert [got[i] for i in (1, 2, 3)] == [[("und", 0.0)]] * 3
    assert got[4][0][0] == "en" and len(set(got[6])) == 1 and len(got[6]) == 2
    kept = language.accepted(docs, model)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert not {1, 2, 3} & set(ids) and ids.count(6) == 2


def test_empty_table_and_no_language(documents):
    empty = documents("x").where("false")
    assert language.identify(empty, language.fit(empty)).collect() == []
    unnamed = documents((1, "word", None))
    assert [r.lang_pred for r in language.identify(unnamed, language.fit(unnamed)).collect()] == ["und"]


def test_many_languages_and_all_grams_are_learnt(documents):
    """More languages than any bound, and code lengths of the whole sample, grams seen once included."""
    names = [f"l{i:03}" for i in range(230)]
    rows = [(i * 10 + k, f"{chr(0x4E00 + i)}{chr(0x4E01 + i)} w{i}", name) for i, name in enumerate(names) for k in range(6)]
    docs = documents(*rows)
    model = language.fit(docs)
    assert model.languages == names
    probes = ["w17", chr(0x4E00 + 40), "zz w"]
    texts = defaultdict(list)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            texts[lang].append(text)
    bits = model.bits(pa.array(probes))
    for lang in names[::23]:
        want = [_brute_bits(texts[lang], p, language.ORDER) for p in probes]
        assert np.allclose(bits[:, names.index(lang)], want)
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_rejected_texts(documents):
    """Short clean texts stay, though several languages code them alike; what reads like none goes."""
    docs = documents(*_docs(), (900, "was", None), (901, "ᚠᛇᚻ᛫ᛒᛦᚦ᛫ᚠᚱᚩᚠᚢᚱ", None), (902, "12", None))
    kept = {r.doc_id for r in language.accepted(docs, language.fit(docs)).collect()}
    assert kept == {i for i, _, _ in _docs()} | {900}
