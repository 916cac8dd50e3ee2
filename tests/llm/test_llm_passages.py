"""Passages that repeat inside lines, against brute force."""

from collections import Counter

import numpy as np
import pytest

from fallline.llm import passages
from llm_fixtures import awkward, make_docs  # noqa: F401


def test_passages_inside_lines_are_found_however_they_are_wrapped(make_docs, awkward):  # noqa: F811
    rng = np.random.default_rng(21)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    wrapped = lambda x, n: "\n".join(" ".join(x.split()[k : k + n]) for k in range(0, len(x.split()), n))
    passage, short, other = text(60), text(49), text(50)
    rows = [
        (10, f"é {text(300)} {passage} {text(400)}"), (11, f"{text(30)}\n{text(7)} {wrapped(passage.upper(), 30)} {text(90)}"),
        (12, wrapped(passage, 4)), (13, f"{text(40)} {short} {text(40)}"), (14, f"{short} {text(9)}"),
        (15, f"{text(3)} {other} {text(2)} {other}"), (16, text(500)),
    ]
    found = passages.repeated(make_docs([*rows, *awkward])).collect()
    got = {(r.doc_id, r.first_word): (r.n_words, r.first_doc, r.removed) for r in found if r.doc_id and r.doc_id >= 10}
    assert got == {
        (10, 301): (60, 10, False), (11, 37): (60, 10, True), (12, 0): (60, 10, True),
        (15, 3): (50, 15, False), (15, 55): (50, 15, True),
    }
    assert any(r.doc_id is None for r in found)  # the text of 1 and 2
    assert {(r.first_word, r.n_words, r.removed) for r in found if r.doc_id == 8} == {(0, 52, False), (3, 209_997, True)}
    assert passages.repeated(make_docs([])).count() == 0


@pytest.mark.parametrize("least", (2, 5, 8))
def test_passages_are_those_of_all_windows(make_docs, monkeypatch, least):  # noqa: F811
    monkeypatch.setattr(passages, "HELD", 7)
    rng = np.random.default_rng(least)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3, n)) for n in rng.integers(0, 40, 30)]
    windows = {(d, k): tuple(x.split()[k : k + least]) for d, x in enumerate(texts) for k in range(len(x.split()) - least + 1)}
    times, first = Counter(windows.values()), {}
    for at, held in sorted(windows.items()):
        first.setdefault(held, at)
    want = {(*at, first[x][0], first[x] != at) for at, x in windows.items() if times[x] > 1}
    found = passages.repeated(make_docs(list(enumerate(texts))), least=least).collect()
    got = [(r.doc_id, r.first_word + k, r.first_doc, r.removed) for r in found for k in range(r.n_words - least + 1)]
    assert len(got) == len(want) and set(got) == want
