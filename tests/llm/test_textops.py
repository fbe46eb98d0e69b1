"""Words, shingles and hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import textops as tx

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab AB\n\t\x0b\x1c\x85é日😀."), max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 60))
def test_words(values, size):
    seen = 0
    by_hash: dict[int, bytes] = {}
    for c in tx.chunks(pa.array(values, pa.string()), size):
        w = tx.words(c)
        h = tx.word_hashes(c, w)
        for i in range(len(c)):
            raw = (values[c.first + i] or "").encode()
            assert c.text(i) == raw
            mine = [c.data[a:b].tobytes() for a, b in zip(w.start[w.of[i] : w.of[i + 1]], w.end[w.of[i] : w.of[i + 1]])]
            assert mine == WORD.findall(raw)
            for word, k in zip(mine, h[w.of[i] : w.of[i + 1]].tolist()):
                assert by_hash.setdefault(k, word) == word
        seen += len(c)
    assert seen == len(values)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingles(values, n):
    sets, plain = [], []
    for c in tx.chunks(pa.array(values, pa.string())):
        sets += [frozenset(s.tolist()) for s in tx.shingle_sets(c, n)]
    for v in values:
        w = [x.lower() for x in WORD.findall((v or "").encode())]
        plain.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for a, pa_ in zip(sets, plain):
        for b, pb in zip(sets, plain):
            assert len(a & b) == len(pa_ & pb)


def test_order_and_place_count():
    c = next(tx.chunks(pa.array(["a b c d", "d c b a", "a b c d "])))
    s = list(tx.shingle_sets(c, 3))
    assert not set(s[0].tolist()) & set(s[1].tolist()) and np.array_equal(s[0], s[2])
