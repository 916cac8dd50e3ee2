"""Owners of equal texts against a plain dictionary, and the trie on its own."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from llm_fixtures import awkward, make_docs  # noqa: F401

from fallline.llm import exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain(rows):
    """All columns but ``kept``, and how many rows of each text are kept."""
    groups = defaultdict(list)
    for row in rows:
        groups[normal(row.text)].append(row.doc_id)
    ids = {t: min(v, key=lambda x: (x is None, x or 0)) for t, v in groups.items()}
    return Counter(
        (r.doc_id, ids[normal(r.text)], len(groups[normal(r.text)]), sha256(normal(r.text).encode()).hexdigest())
        for r in rows
    )


def check(docs, **options):
    found = exact_dedup.owners(docs, **options).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == plain(docs.collect())
    kept = [r for r in found if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert Counter(r.text_sha256 for r in kept) == dict.fromkeys({r.text_sha256 for r in found}, 1)


def test_awkward_rows(spark, make_docs, awkward):
    docs = make_docs([*awkward, (20, "a  b"), (21, "a b"), (22, " a b"), (23, "a b\n"), (24, "a b"), (19, "A b")])
    check(docs)
    check(make_docs([]))
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    assert Counter(normal(r.text) for r in left.collect()) == dict.fromkeys({normal(r.text) for r in docs.collect()}, 1)
    assert {1, 20} <= {r.doc_id for r in left.collect()} and 21 not in {r.doc_id for r in left.collect()}


@pytest.mark.parametrize("fan_in, memory", [(2, 1 << 20), (3, 700), (1024, 200)])
def test_hot_texts_and_little_memory(spark, make_docs, fan_in, memory):
    # a text with a third of all rows, many families, and texts that begin alike
    rows = [(1000 - k, "one text \t that is everywhere", "en", "a") for k in range(100)]
    rows += [(k, f"family {k % 37} " + "x" * (k % 37), "en", "a") for k in range(200)]
    docs = make_docs(rows, partitions=23)
    check(docs, fan_in=fan_in, memory=memory)


def test_keys_that_collide(spark, make_docs, monkeypatch):
    # all texts of a length have one hash; tasks read the module anew, so the class is used here
    owners = exact_dedup._Owners(1 << 20)
    texts = [b"abcd", b"abce", b"abcd", b"zbcd", b""]
    nodes = [owners.put(t, k, (k, k), 1, (4, 7), False) for k, t in enumerate(texts)]
    assert nodes == [0, 1, 0, 3, 4]


def test_trie_holds_what_a_dictionary_holds():
    rng = np.random.default_rng(5)
    trie, want = exact_dedup.Trie(), {}
    for k in range(3000):
        text = bytes(rng.choice(list(b"ab c"), rng.integers(0, 12)))
        node = trie.find(text)
        if node[2] is None:
            node[2] = k
        want.setdefault(text, k)
        assert node[2] == want[text]
    assert dict(trie.terminals()) == want
    for node in [trie.root]:  # an inner node without a value has at least two branches
        todo = list(node[1].values())
        while todo:
            node = todo.pop()
            assert node[2] is not None or len(node[1]) > 1
            todo.extend(node[1].values())
    held = trie.size()
    branch = trie.heaviest()
    below = dict(trie.terminals(branch))
    assert below and all(t[0] == branch for t in below)
    trie.give_up(branch)
    assert dict(trie.terminals()) == {t: v for t, v in want.items() if t not in below} and trie.size() < held
