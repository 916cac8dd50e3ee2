"""Sets that share frequent shingles and do not link: held against each other in blocks, every pair."""

import random

import numpy as np
import pytest

from fallline.llm import graph, ngram_join, paragraphs
from llm_fixtures import make_docs  # noqa: F401


@pytest.mark.parametrize("block", [5, 1024])
def test_every_pair_of_a_key_is_held_against_each_other(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CELLS", 64)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    rows, sets = [], {}
    for k in range(40):
        size = rng.choice((6, 50, 60))
        found = np.array(rng.sample(base[:size], size - rng.randint(0, 5)) + [rng.getrandbits(64) for _ in range(rng.randint(0, 4))], np.uint64)
        sets[k] = set(found.tolist())
        bits = ngram_join.bits_of(found).view(np.int64).tolist()
        rows += [(token, k, len(found), len(found), k // 2, bits) for token in (1, 2) if token == 1 or k % 3]
    df = spark.createDataFrame(rows, "token bigint, set_id bigint, n bigint, rest bigint, group_id bigint, bits array<bigint>")
    got = [(r.a, r.b) for r in ngram_join.pairs_within(df, ["token"], 80).collect()]
    linked = {(a, b) for a in sets for b in sets if a < b and a // 2 != b // 2 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and linked and linked <= set(got)
    assert len(got) < 40 * 39 // 4


def test_a_family_that_does_not_link_is_not_paired_row_by_row(make_docs, monkeypatch):  # noqa: F811
    """Texts of one original, each with edits of its own: alike, but too few are similar enough to link."""
    made = []

    def staged(df, name):
        made.append(graph.staged(df, name))
        made[-1] = (made[-1].count(), name, made[-1])
        return made[-1][2]

    monkeypatch.setattr(ngram_join, "staged", staged)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(150), 5):
            words[at] = f"x{k}y{at}"
        docs.append((k, " ".join(words)))
    found = {r.doc_id: r.component_id for r in ngram_join.similar(make_docs(docs)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(146)} for w in (t.split() for _, t in docs)]
    parent = list(range(120))
    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert found == dict(enumerate(parent))
    assert max(made, key=lambda x: x[0])[0] < 5000  # of 7140 pairs


@pytest.mark.parametrize("following", [0, 4])
def test_paragraphs_that_are_no_neighbours_in_a_band(make_docs, monkeypatch, following):  # noqa: F811
    """A family of paragraphs too far from each other, but for twins, which are found wherever they stand."""
    monkeypatch.setattr(paragraphs, "FOLLOWING", following)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(100)]
    docs = []
    for k in range(30):
        words = list(base)
        places = rng.sample(range(100), 4)
        for at in places[:2]:
            words[at] = f"x{k}y{at}"
        docs.append((2 * k, " ".join(words)))
        # of 96 shingles at least 86 stay: 86 of 106 are common
        for at in places[2:]:
            words[at] = f"z{k}y{at}"
        docs.append((2 * k + 1, " ".join(words)))
    found = paragraphs.repeated(make_docs(docs)).collect()
    cluster = {r.doc_id: r.first_doc for r in found}
    assert {k: cluster.get(2 * k) == cluster.get(2 * k + 1) is not None for k in range(30)} == dict.fromkeys(range(30), True)


def _family(rng, n, edits):
    base = [f"w{k}" for k in range(150)]
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(150), edits):
            words[at] = f"x{k}y{at}"
        yield k, " ".join(words)


def _clusters(docs):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    parent = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if parent[a] != parent[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    return dict(enumerate(parent))


def test_sets_with_too_many_pairs_are_compared_as_a_whole_inside_tasks(make_docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(ngram_join, "CLOSE", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    docs = list(_family(random.Random(3), 160, 3))
    found = {r.doc_id: r.component_id for r in ngram_join.similar(make_docs(docs)).collect()}
    want = _clusters(docs)
    assert found == want and 20 < len(set(want.values())) < 160


def test_a_pair_leaves_at_its_first_key_alone(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(60)]
    rows = []
    for k in range(12):
        found = np.array(base + [rng.getrandbits(64) for _ in range(6)], np.uint64)
        bits = ngram_join.bits_of(found).view(np.int64).tolist()
        rows += [(token, k, 66, 66 - token, k, bits) for token in range(8)]
    df = spark.createDataFrame(rows, "token bigint, set_id bigint, n bigint, rest bigint, group_id bigint, bits array<bigint>")
    monkeypatch.setattr(type(df), "distinct", lambda self: self)
    assert ngram_join.pairs_within(df, ["token"], 80).count() == 8 * 66
    df = ngram_join.listed(df, ["token"], "-rest")
    assert ngram_join.pairs_within(df, ["token"], 80).count() == 66
    monkeypatch.setattr(ngram_join, "CLOSE", 2)
    named = [tuple(r) for r in ngram_join.pairs_within(df, ["token"], 80).collect()]
    assert sorted(named) == [(k, None, 0) for k in range(12)]


def test_minhashes_of_many_texts_are_those_of_each(monkeypatch):
    monkeypatch.setattr(paragraphs, "SHINGLES", 100)
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 4, 5, 6, 40, 300]))).encode() for _ in range(80)]
    for words in (1, 5, 7):
        want = [
            (np.unique(paragraphs.T.windows(paragraphs.T.word_hashes(x), words)) * (paragraphs._MASKS | np.uint64(1)) ^ paragraphs._MASKS).min(axis=1)
            for x in texts
        ]
        assert (paragraphs.minhashes(texts, words) == np.array(want)).all()
    assert paragraphs.minhashes([], 5).shape == (0, paragraphs.BANDS * paragraphs.ROWS)


def test_paragraphs_with_too_many_pairs_are_compared_as_a_whole(make_docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(ngram_join, "CLOSE", 0)
    test_paragraphs_that_are_no_neighbours_in_a_band(make_docs, monkeypatch, 0)
