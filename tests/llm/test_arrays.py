import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_guard.llm import arrays

TEXTS = st.lists(st.none() | st.text("ab é\n\t,A", max_size=30), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    data, offsets = arrays.text_bytes(pa.array(texts, pa.string()))
    starts, ends, owner = arrays.word_spans(data, offsets)
    got = [(int(o), bytes(data[s:e])) for s, e, o in zip(starts, ends, owner)]
    want = [
        (i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    ]
    assert got == want
    hashes = arrays.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len({w for _, w in want})


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_grams_stay_inside_a_text(texts, n):
    data, offsets = arrays.text_bytes(pa.array(texts, pa.string()))
    starts, ends, owner = arrays.word_spans(data, offsets)
    keys, text = arrays.grams(arrays.word_hashes(data, starts, ends), owner, n)
    want = []
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        want += [(i, tuple(words[j : j + n])) for j in range(len(words) - n + 1)]
    assert text.tolist() == [i for i, _ in want]
    assert len(set(keys.tolist())) == len({g for _, g in want})


def test_blocks_cover_all_texts_once():
    offsets = np.array([0, 0, 5, 5, 30, 31, 31])
    parts = list(arrays.blocks(offsets, 10))
    assert parts[0][0] == 0 and parts[-1][1] == 6
    assert all(a < b for a, b in parts) and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))


def test_table_finds_its_keys_only():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000).astype(np.uint64))
    table = arrays.KeyTable(keys[::2])
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all()
    assert (table.find(keys[1::2]) == -1).all()
    assert (arrays.KeyTable(keys[:0]).find(keys) == -1).all()


def test_sliced_arrays():
    column = pa.array(["aa", "b b", None, "c"])
    data, offsets = arrays.text_bytes(column.slice(1, 3))
    assert bytes(data) == b"b bc" and offsets.tolist() == [0, 3, 3, 4]
