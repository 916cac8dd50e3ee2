"""The hash tree against a plain one that holds the whole table."""

from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from llm_fixtures import awkward, make_docs  # noqa: F401

from fallline.llm import merkle


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, tamper=5):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row, by lists alone."""
    trees = {}
    for row in rows:
        leaf = leaf_of(row, row.text)
        chosen = row.doc_id is not None and crc32(str(row.doc_id).encode()) % tamper == 0
        trees.setdefault(row.source, []).append((row.doc_id, leaf, leaf_of(row, lowered(row.text)) if chosen else leaf))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
        return out

    def way(out, k):
        for nodes in out[:-1]:
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            yield run[: k % 16], run[k % 16 + 1 :]
            k //= 16

    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        trees[source].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    inner = {s: levels([x[1] for x in trees[s]]) for s in order}
    outer = levels([inner[s][-1][0] for s in order])
    root = outer[-1][0] if order else None
    for place, source in enumerate(order):
        for k, (doc_id, leaf, checked) in enumerate(trees[source]):
            steps = [*way(inner[source], k), *way(outer, place)]
            node = checked
            for left, right in steps:
                node = digest("".join([*left, node, *right]))
            proof = digest("".join(x for left, right in steps for x in left + right))
            yield doc_id, leaf, inner[source][-1][0], root, proof, node, node == root


def with_counts(docs):
    return docs.withColumn("n_chars", F.when(F.col("doc_id") != 6, F.length("text")))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("levels", [1, 2])
def test_trees_of_several_superblocks(spark, make_docs, levels):
    # one source with most of the rows, one with an odd last run, one with one row, many small ones
    rows = [(7 * k, f"Text No. {k}", "en", "hot") for k in range(601)]
    rows += [(7 * k + 1, f"text {k}", None, None) for k in range(33)] + [(3, "Alone", "fr", "z")]
    rows += [(10_000 + k, f"Of source {k}", "de", f"s{k:03}") for k in range(40)]
    docs = with_counts(make_docs(rows))
    found = merkle.prove(docs, levels=levels)
    assert rows_of(found) == Counter(plain(docs.collect()))
    assert 0 < found.filter("NOT verified").count() < 200


def test_awkward_rows(spark, make_docs, awkward):
    docs = with_counts(make_docs([*awkward, *[(9, "same", "en", "a")] * 40, (2**60 + 1, "Big", "en", "b")]))
    want = Counter(plain(docs.collect()))
    assert rows_of(merkle.prove(docs)) == want
    assert rows_of(merkle.prove(docs, levels=1)) == want
    assert (2**60 + 1) in {r[0] for r in want}


def test_every_row_tampered(spark, make_docs):
    docs = with_counts(make_docs([(1, "A"), (2, "b"), (3, None), (None, "C")]))
    found = {r.doc_id: r for r in merkle.prove(docs, tamper=1).collect()}
    assert [found[k].verified for k in (1, 2, 3, None)] == [False, True, True, True]
    assert {r.proof_sha256 for r in found.values()} != {digest("")}


def test_one_row_and_none(spark, make_docs):
    docs = with_counts(make_docs([(4, "only", "en", "x")]))
    row = merkle.prove(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded_root
    assert row.proof_sha256 == digest("") and row.verified
    empty = merkle.prove(with_counts(make_docs([])))
    assert empty.count() == 0 and empty.columns == merkle.prove(docs).columns
