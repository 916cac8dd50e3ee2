"""The registered queries over whole tables: against SQL, or against a plain version."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from llm_fixtures import awkward, make_docs  # noqa: F401

from fallline.llm import decontaminate, oracles, packing, paragraphs, quality_model, registry

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "pages"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{MIDDLE}/{table}.parquet'")
    df = registry.REGISTRY[name](spark, MIDDLE)
    result = database.execute(oracles.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(result.fetchall())
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == want


def test_queries_are_registered():
    names = entry_module.queries()
    assert set(registry.REGISTRY) | {"pipeline"} <= set(names)
    assert {int(n[2:].split("_")[0]) for n in registry.REGISTRY} == set(range(1, 14))


def test_leaks_are_the_planted_items(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()
    items = spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()
    planted = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    found = registry.REGISTRY["op1_decontamination"](spark, MIDDLE).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted and len(found) == len(planted)


def test_retrieval_matches_scoring_every_item():
    rng = np.random.default_rng(3)
    names = [f"w{k}" for k in range(120)]
    items = [(k, " ".join(rng.choice(names, rng.integers(1, 30)))) for k in range(70)]
    words = [decontaminate.T.word_hashes(x.encode()) for _, x in items]
    df = Counter(int(x) for w in words for x in np.unique(w).view(np.int64))
    index = decontaminate.build(items, df, len(items), float(np.mean([len(w) for w in words])))
    for _ in range(60):
        text = decontaminate.T.word_hashes(" ".join(rng.choice(names, rng.integers(0, 150))).encode())
        n = max(1, -(-len(text) // index.width) - 1)
        want = set()
        for p in range(n):
            have = set(text[p * index.width : (p + 2) * index.width].tolist())
            for k in range(len(items)):
                score = sum(
                    index.weight[at]
                    for t in range(len(index.terms)) if int(index.terms[t]) in have
                    for at in range(index.start[t], index.start[t + 1]) if index.item[at] == k
                )
                if score >= 0.3:
                    want.add((p, k))
        assert {(p, k) for p, k, _ in decontaminate.retrieve(index, text, 0.3)} == (want if len(text) else set())


def test_leaks_of_awkward_rows(spark, make_docs, awkward, monkeypatch):
    rows = [(k, f"what is the {k} th answer to all questions\nit is number {k} of course my friend") for k in range(9)]
    items = spark.createDataFrame([*rows, (20, None), (21, ""), (22, " "), (None, "null id item text here")], "item_id bigint, text string")
    docs = make_docs([*awkward, (30, "Before.\n" + rows[4][1].upper() + "\nAfter."), (31, rows[4][1].split("\n")[0])])
    found = decontaminate.find(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(30, 4)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(awkward) + 1
    assert decontaminate.find(docs, items.limit(0)).count() == 0
    assert decontaminate.find(make_docs([]), items).count() == 0
    monkeypatch.setattr(decontaminate, "SHARD", 3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()} == {(30, 4)}


def test_model_learns_without_the_held_out(spark, make_docs, awkward):
    rows = registry.REGISTRY["op2_quality_model"](spark, MIDDLE).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    again = registry.REGISTRY["op2_quality_model"](spark, MIDDLE).collect()
    assert sorted(rows) == sorted(again)
    marks = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    out = quality_model.score(make_docs(awkward), marks).collect()
    assert len(out) == len(awkward) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality_model.score(make_docs(awkward), marks.limit(0)).collect()} == {0.5}
    assert quality_model.score(make_docs([]), marks).count() == 0


def test_pairs_by_the_square_of_the_sum():
    rng = np.random.default_rng(1)
    at, x = np.array([3, 9, 40, 77]), rng.random(4)
    model = quality_model.Machine(0.3, rng.normal(size=100), rng.normal(size=(100, 5)))
    pairs = sum(
        model.vectors[at[i]] @ model.vectors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i)
    )
    assert model.raw(at, x) == pytest.approx(0.3 + model.weight[at] @ x + pairs)


def plain_best_fit(pieces, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [
            (capacity - used - size, b)
            for b, (used, members) in enumerate(bins)
            if used + size <= capacity
            and not (cluster and any(c == cluster for _, c in members))
            and not (source and sum(s == source for s, _ in members) >= per_source)
        ]
        b = min(fits)[1] if fits else len(bins)
        if b == len(bins):
            bins.append((0, []))
        out.append((b, bins[b][0]))
        bins[b] = (bins[b][0] + size, bins[b][1] + [(source, cluster)])
    return out


def test_best_fit_matches_looking_at_every_bin():
    rng = np.random.default_rng(2)
    for _ in range(100):
        pieces = [(int(rng.integers(0, 20)), 1 << int(rng.integers(3)), (1 << int(rng.integers(6))) if rng.random() < 0.7 else 0) for _ in range(60)]
        capacity, per = int(rng.integers(20, 50)), int(rng.integers(1, 4))
        assert list(packing.best_fit(pieces, capacity, per)) == plain_best_fit(pieces, capacity, per)


def _check_bins(rows, capacity, per_source, facts):
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for held in bins.values():
        held.sort(key=lambda r: (r.bin_offset, r.n_words))
        ends = [r.bin_offset + r.n_words for r in held]
        assert ends[-1] <= capacity and all(a <= r.bin_offset for a, r in zip(ends, held[1:]))
        known = [facts[r.doc_id] for r in held if r.doc_id is not None]
        assert max(Counter(s for s, _ in known if s).values(), default=0) <= per_source
        assert max(Counter(t for _, t in known if t).values(), default=0) <= 1


def test_packing_of_whole_tables(spark, make_docs, awkward):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()
    rows = registry.REGISTRY["op6_packing"](spark, MIDDLE).collect()
    words = Counter()
    for r in rows:
        words[r.doc_id] += r.n_words
    assert words == Counter({d.doc_id: len(d.text.encode().split()) for d in docs})
    _check_bins(rows, packing.CAPACITY, packing.PER_SOURCE, {d.doc_id: (d.source, d.text) for d in docs})
    rows = packing.pack(make_docs(awkward), capacity=300, shard=4).collect()
    assert {str(r.doc_id) for r in rows} == {str(r[0]) for r in awkward}
    assert sum(r.n_words for r in rows if r.doc_id == 8) == 210_000
    assert sum(r.n_words for r in rows if r.doc_id == 1) == 400
    assert packing.pack(make_docs([])).count() == 0


def test_near_copies_share_no_bin(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words).upper(), "\n".join(words), " ".join([*words[:30], "x", *words[31:]])]
    rows = [(k, x, f"s{k}") for k, x in enumerate(texts)] + [(None, texts[0], "t"), (9, "other text", "u")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    bins = defaultdict(list)
    for r in registry.REGISTRY["op6_packing"](spark, str(tmp_path)).collect():
        bins[r.bin_id].append(r.doc_id)
    assert sorted(len([x for x in held if x != 9]) for held in bins.values()) == [1] * 5


def test_repeated_paragraphs(spark, make_docs, awkward):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    base, other = text(60), text(80)
    near = base.split()
    near[30] = "changed"
    rows = [
        (10, f"{text(30)}\n{base}\n{text(40)}"), (11, f"é {text(30)}\n{' '.join(near)}"), (12, base.upper() + "\nshort\nshort"),
        (13, text(50)), (14, f"{other}\n{other}"), (15, "\n".join(["short line"] * 5)),
    ]
    docs = make_docs([*rows, *awkward])
    found = paragraphs.repeated(docs).collect()
    got = {(r.doc_id, r.paragraph): (r.first_doc, r.first_paragraph, r.removed, r.copies) for r in found if r.doc_id and r.doc_id >= 10}
    assert got == {
        (10, 1): (10, 1, False, 3), (11, 1): (10, 1, True, 3), (12, 0): (10, 1, True, 3),
        (14, 0): (14, 0, False, 2), (14, 1): (14, 0, True, 2),
    }
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        if r.doc_id in texts:
            assert texts[r.doc_id][r.start : r.end] == texts[r.doc_id].split("\n")[r.paragraph]
    cut = paragraphs.without_repeats(make_docs(rows))
    assert cut.columns == docs.columns
    after = {r.doc_id: r.text for r in cut.collect()}
    assert after[14] == other and after[12] == "short\nshort" and after[13] == texts[13] and after[10] == texts[10]
    assert paragraphs.repeated(make_docs([])).count() == 0


def test_repeated_paragraphs_of_a_whole_table(spark):
    """Every pair of similar paragraphs, found by looking at all that share a shingle."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    sets, seen, near = {}, defaultdict(set), set()
    for d in docs:
        for k, line in enumerate(d.text.split("\n")):
            words = line.lower().split()
            if len(words) >= paragraphs.LEAST_WORDS:
                sets[d.doc_id, k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for key, own in sets.items():
        for other in {x for s in own for x in seen[s]}:
            both = len(own & sets[other])
            if 100 * both >= 80 * len(own | sets[other]):
                near |= {key, other}
        for s in own:
            seen[s].add(key)
    rows = registry.REGISTRY["op7_paragraphs"](spark, SMALL).collect()
    found = {(r.doc_id, r.paragraph) for r in rows}
    assert found <= near and len(found) >= 0.98 * len(near)


def test_paragraph_clusters_are_those_of_all_pairs(make_docs):
    """A family of copies that are just below 0.8 to most others: every link and cluster is found."""
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(60)]
    lines = [" ".join(base)]
    for _ in range(150):
        near = list(base)
        for at in rng.choice(60, 3, replace=False):
            near[at] = f"c{rng.integers(10**6)}"
        lines.append(" ".join(near))
        twin = list(near)
        twin[int(rng.integers(60))] = "twin"
        lines.append(" ".join(twin))
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in map(str.split, lines)]
    root = list(range(len(sets)))
    for k, own in enumerate(sets):
        for j in range(k):
            both = len(own & sets[j])
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both) and root[j] != root[k]:
                gone, kept = max(root[j], root[k]), min(root[j], root[k])
                root = [kept if x == gone else x for x in root]
    sizes = Counter(root)
    want = {k: (first, sizes[first]) for k, first in enumerate(root) if sizes[first] > 1}
    found = paragraphs.repeated(make_docs(list(enumerate(lines)))).collect()
    assert {r.doc_id: (r.first_doc, r.copies) for r in found} == want


def test_passages_are_found_however_they_are_wrapped(make_docs):
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    wrapped = lambda x, n: "\n".join(" ".join(x.split()[k : k + n]) for k in range(0, len(x.split()), n))
    passage, short, tiny = text(60), text(7), text(3)
    rows = [
        (1, f"{text(30)}\n{passage}\n{text(40)}"), (2, f"é {text(30)}\n{wrapped(passage, 12)}\n{text(40)}"),
        (3, wrapped(passage, 4)), (4, f"{text(40)}\n{short}\n{text(40)}"), (5, f"{short}\n\n{text(30)}"),
        (6, f"{tiny}\n{text(24)}"), (7, f"{text(9)}\n\n{text(9)}"),
    ]
    docs = make_docs(rows)
    found = paragraphs.repeated(docs).collect()
    assert {(r.doc_id, r.first_line, r.n_lines): (r.first_doc, r.copies, r.removed) for r in found} == {
        (1, 1, 1): (1, 3, False), (2, 1, 5): (1, 3, True), (3, 0, 15): (1, 3, True),
        (4, 1, 1): (4, 2, False), (5, 0, 1): (4, 2, True),
    }
    texts = dict(rows)
    for r in found:
        held = texts[r.doc_id].split("\n")[r.first_line : r.first_line + r.n_lines]
        assert texts[r.doc_id][r.start : r.end] == "\n".join(held)
    after = {r.doc_id: r.text for r in paragraphs.without_repeats(docs).collect()}
    lines = texts[2].split("\n")
    assert after[2] == f"{lines[0]}\n{lines[-1]}" and after[3] == "" and after[5] == texts[5].split("\n", 1)[1]
    assert all(after[k] == texts[k] for k in (1, 4, 6, 7))


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rules = {r.doc_id for r in registry.REGISTRY["op8_fertility"](spark, SMALL).collect() if r.kept}
    left = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id IN (%s)" % ",".join(map(str, rules)))
    one = {r.doc_id for r in registry.ngram_join.similar(left).collect() if r.doc_id == r.component_id}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {i for i in one if not any(x in docs[i] for x in items)}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == want
    words = Counter()
    for r in rows:
        words[r.doc_id] += r.n_words
    assert all(words[i] == len(registry.pii.redacted(docs[i]).encode().split()) for i in want)


def test_a_long_item_makes_no_passage_wider_for_short_ones():
    rng = np.random.default_rng(5)
    names = np.array([f"w{i}" for i in range(3000)])
    text = lambda n: " ".join(rng.choice(names, n))
    items = [(k, text(30) + "\n" + text(8)) for k in range(500)] + [(500, text(5000)), (501, text(64)), (502, text(65))]
    hashes = decontaminate.T.word_hashes
    words = [hashes(x.encode()) for _, x in items]
    df = Counter(int(x) for w in words for x in np.unique(w).view(np.int64))
    indexes = decontaminate.by_length(items, df, len(items), float(np.mean([len(w) for w in words])))
    assert [len(i.ids) for i in indexes] == [501, 1, 1] and [i.width for i in indexes] == [64, 65, 5000]
    planted = [7, 300, 500, 501, 502]
    found = hashes(" ".join(f"{text(4000)} {items[k][1]}" for k in planted).encode())
    retrieved = [decontaminate.retrieve(i, found, decontaminate.THRESHOLD) for i in indexes]
    leaked = [{i.ids[k[0]] for k in decontaminate.leaks(i, found, 0.5, 0.5)} for i in indexes]
    assert leaked == [{7, 300, 501}, {502}, {500}]
    # at most two windows hold a planted item whole; no other item reaches the threshold
    assert len(retrieved[0]) <= 3 * 3
