"""Clusters and sizes for packing, from the pass that sketches the texts."""

from collections import defaultdict

import numpy as np

from fallline.llm import ngram_join, packing, registry
from fallline.llm import text as T
from llm_fixtures import awkward, make_docs  # noqa: F401


def test_packing_writes_no_copy_of_the_documents(spark, tmp_path, monkeypatch):
    """Texts are read for sketches and for pairs to be asked, and written for neither."""
    names, staged = [], ngram_join.staged

    def named(df, name):
        names.append((name, "text" in df.columns and df.count()))
        return staged(df, name)

    for module in (ngram_join, packing):
        monkeypatch.setattr(module, "staged", named)
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words, "a"), (2, words.upper(), "b"), (3, "another text that stands alone here", "c"), (4, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.REGISTRY["op6_packing"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_words) for r in found) == [(1, 60), (2, 60), (3, 6), (4, 0)]
    assert "keyed" not in dict(names) and not any(n for _, n in names)


def test_sized_clusters(make_docs, awkward):  # noqa: F811
    near = " ".join(["changed", *(f"w{k}" for k in range(1, 200))])
    rows = [*awkward, (20, near, "x", "c"), (21, " \t\n\x0b\f\r ", "x", None), (22, " ", "x", "c"), (23, "one", None, "d")]
    found = ngram_join.sized_clusters(make_docs(rows)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((r[0], r[3] if len(r) > 3 else None, len((r[1] or "").encode().split())) for r in rows), key=key)
    assert sorted(((r.doc_id, r.source, r.n_words) for r in found), key=key) == want
    held = defaultdict(list)
    for r in found:
        held[r.cluster].append(r.doc_id)
    assert sorted(held.pop(None), key=str) == [3, 4, None]  # null and empty texts
    assert sorted(sorted(map(str, x)) for x in held.values()) == [
        ["1", "1", "2", "20", "None"], ["21", "5"], ["22"], ["23", "6"], ["7"], ["8"],
    ]


def test_distinct_values():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50):
        values = rng.integers(0, 20, n).astype(np.uint64)
        assert (T.distinct(values) == np.unique(values)).all()
