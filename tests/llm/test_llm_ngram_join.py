import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from llm_fixtures import awkward, make_docs  # noqa: F401

from fallline.llm import graph, ngram_join


def plain(docs):
    """Sets, all pairs that share a shingle, and components, in plain Python."""
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for i, own in sets.items():
        shared = Counter(j for x in own for j in seen[x])
        for x in own:
            seen[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    line = " ".join(words[:14])
    docs = []
    for k in range(120):
        own = " ".join(rng.choice(words) for _ in range(rng.choice([2, 4, 6, 12, 30, 80])))
        docs.append(own if k % 2 else line + "\n" + own)
    base = [rng.choice(words) for _ in range(90)]
    for _ in range(80):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        docs.append(" ".join(near))
    docs += [line + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(40)]
    docs += ["", "  ", None, line, line.upper()]
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "frequent"), [(1, 64), (2, 3)])
def test_components_match_all_pairs(make_docs, seed, frequent):
    docs = corpus(seed)
    found = ngram_join.similar(make_docs(docs), frequent=frequent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain(docs)


def test_awkward_rows(make_docs, awkward):
    docs = make_docs(awkward)
    rows = ngram_join.similar(docs).collect()
    assert len(rows) == len(awkward)
    same = [r for r in rows if r.n_shingles == 196]
    assert sorted(str(r.doc_id) for r in same) == ["1", "1", "2", "None"]
    assert {r.component_id for r in same} == {1}
    assert {(r.doc_id, r.component_id) for r in rows if r.n_shingles == 0} == {
        (3, 3), (None, None), (4, 4), (5, 5)
    }
    assert [r.n_shingles for r in rows if r.doc_id == 8] == [3]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        [1, 1, 3, None, None, 4, 5, 6, 7, 8]
    )


def test_pipeline_keeps_one_row_of_each_group(spark, make_docs, awkward):
    texts = [" ".join(f"{x}{k}" for k in range(40)) for x in "abc"]
    rows = [(11, texts[0]), (12, texts[0]), (12, texts[1]), (None, texts[2]), (None, texts[2])]
    docs = make_docs([*awkward, *rows])
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 3, None, None, 4, 5, 6, 7, 8, 11, 12])
    assert [r.text for r in kept if r.doc_id == 12] == [texts[1]]
    assert sorted(str(r.text) for r in kept if r.doc_id is None) == ["None", texts[2]]


def test_pairs_that_are_asked_in_rounds_give_the_same_links(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "ASKED", 0)
    monkeypatch.setattr(ngram_join, "FEW", 0)
    docs = corpus(4)
    found = ngram_join.similar(make_docs(docs), frequent=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain(docs)


def test_empty_table(make_docs):
    assert ngram_join.similar(make_docs([])).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in graph.components(links).collect()}
    assert found == {k: 0 for k in range(61)} | {100: 100, 101: 100}
    assert graph.components(links.limit(0)).count() == 0


@pytest.mark.parametrize(("held", "rounds"), [(1 << 20, 3), (8, 12)])
def test_components_take_few_rounds(spark, monkeypatch, held, rounds):
    """Links of a task are joined at once, so the rounds do not grow with the path; few links at once give the same."""
    made = []
    monkeypatch.setattr(graph, "staged", lambda df, name, staged=graph.staged: made.append(name) or staged(df, name))
    monkeypatch.setattr(graph, "HELD_LINKS", held)
    rng = random.Random(2)
    names = rng.sample(range(-5000, 5000), 300)
    pairs = [(a, b) for a, b in zip(names, names[1:]) if rng.random() < 0.98] + [(9000, 9001), (9001, 9000), (7, 7)]
    rng.shuffle(pairs)
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(6)).collect()}
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in pairs:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root
    assert len(made) <= 1 + rounds
