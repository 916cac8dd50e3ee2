import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fallline.llm import text as T


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\t\x0b\x0cé.", max_size=40), max_size=6))
def test_words_and_shingles_match_plain_python(texts):
    data = [x.encode() for x in texts]
    assert [(at, len(w)) for at, w in T.texts_words(data)] == [
        (k, len(x.split())) for k, x in enumerate(data)
    ]
    sets = [s for _, s in T.shingle_sets(data)]
    plain = []
    for x in data:
        words = x.lower().split()
        plain.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(sets)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_long_texts_in_blocks_give_the_same_words(monkeypatch):
    rng = random.Random(1)
    data = " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(3000)).encode()
    whole = T.word_hashes(data)
    monkeypatch.setattr(T, "BLOCK", 1000)
    assert np.array_equal(whole, T.word_hashes(data))
    assert [len(w) for _, w in T.texts_words([b"a b", data, b"", b"c"])] == [2, 3000, 0, 1]
