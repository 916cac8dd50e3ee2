"""The divergence of sources against plain counting, and the perfect hash on its own."""

import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from llm_fixtures import awkward, make_docs  # noqa: F401

from fallline.llm import divergence


def plain(rows, least=10, top=10):
    words = [
        (r.lang or "", r.source or "", [
            "".join(c.lower() if c < "\x80" else c for c in w)
            for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")
        ])
        for r in rows
    ]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, found in words:
        seen[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = Counter()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        common = Counter()
        for s in sources:
            common.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(common)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            near = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            for rank, (v, o) in enumerate(sorted(near), 1):
                out[lang, s, "pair", o.decode(), -v, rank] += 1
            own = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for rank, (v, t) in enumerate(sorted(own)[:top], 1):
                out[lang, s, "term", t.decode(), -v, rank] += 1
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def some(make_docs, n=150):
    rng = np.random.default_rng(11)
    names = [f"{a}{b}{c}" for a in "abÄé" for b in "xY日" for c in ("", "q", "long" * 30)]
    rows = []
    for k in range(n):
        text = ", ".join(rng.choice(names, rng.integers(0, 40)))
        rows.append((k, text, ("en", "fr", None)[k % 3], f"s{rng.integers(0, 4) if k % 2 else 0}"))
    return make_docs(rows, partitions=5)


@pytest.mark.parametrize("most_terms", [1_000_000, 7, 0])
def test_all_or_few_terms_sent(spark, make_docs, monkeypatch, most_terms):
    docs = some(make_docs)
    monkeypatch.setattr(divergence, "SHARD", 5)
    assert rows_of(divergence.audit(docs, most_terms=most_terms)) == plain(docs.collect())


def test_small_tiles_and_memory(spark, make_docs, monkeypatch):
    docs = some(make_docs)
    monkeypatch.setattr(divergence, "CELLS", 12)
    assert rows_of(divergence.audit(docs, least=3, top=2)) == plain(docs.collect(), 3, 2)


def test_awkward_rows(spark, make_docs, awkward):
    docs = make_docs([*awkward, (50, "One one", "en", "z"), (51, None, "no terms", "x"), (52, "", "no terms", "y")])
    assert rows_of(divergence.audit(docs)) == plain(docs.collect())
    assert rows_of(divergence.audit(docs, least=1)) == plain(docs.collect(), 1)
    assert divergence.audit(make_docs([])).count() == 0
    assert divergence.audit(make_docs([])).columns == divergence.audit(docs).columns


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    codes = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    moves, slots = divergence.perfect_hash(codes)
    assert sorted(slots) == list(range(len(codes))) and len(moves) == max(1, -(-n // 2))


def test_stored_keys_are_compared():
    words = [f"word{k}".encode() for k in range(400)]
    codes = divergence._codes(words)
    shards, at = [], 0
    for s in range(3000):  # most of the shards get no term
        own = np.flatnonzero((codes >> np.uint64(33)) % np.uint64(3000) == s)
        if not len(own):
            continue
        moves, slots = divergence.perfect_hash(codes[own])
        keys = [words[k].decode() for k in own[np.argsort(slots)]]
        shards.append(SimpleNamespace(shard=s, shards=3000, offset=at, main=len(own), moves=moves.tolist(), keys=keys))
        at += len(own)
    index = divergence.Index(shards)
    assert sorted(index.find(words)) == list(range(400))
    strangers = [f"other{k}".encode() for k in range(2000)] + [b"word1" + b"x" * 50, b"word", b"word3999"]
    assert set(index.find(strangers)) == {-1}
