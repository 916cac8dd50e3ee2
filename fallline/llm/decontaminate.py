"""Benchmark decontamination: every passage of every document asks a BM25 index of the test items.

The index holds the items, in groups by length: up to ``SHORT`` words, up to twice as many, and so on. For each
group a document's passages are windows of words, twice as long as its longest item and half overlapping, so any
item's text lies whole in one of them, and a long item makes no passage wider for short ones. A passage's score for an
item is the BM25 weight of the item's terms that it has, as a share of the item's own weight; all
items at or above ``threshold`` are retrieved. Block-max WAND finds them: a passage whose terms'
maxima add up to less is skipped, then each block of items whose block maxima add up to less, and
only the items of the blocks left are scored.

A retrieved item counts as leaked where the passage has at least ``overlap`` of the word n-grams of
its question and as much of its answer's. The answer is the last line, or the last sentence of
a single line; an item of one sentence is all question.

The items go to the tasks in shards of at most ``SHARD`` items, one pass over the documents for
each with all its groups, so what is broadcast has a fixed bound. Documents are not shuffled. Null and empty
texts, of either side, match nothing; rows that repeat an id are judged each on their own.
"""

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

K1, B = 1.2, 0.75
SHARD, BLOCK_ITEMS = 20_000, 16
#: Words of the items of the first group by length.
SHORT = 64
THRESHOLD, OVERLAP = 0.5, 0.5
#: Cells of passages by blocks that are added up at once.
CELLS = 1 << 21


@dataclass
class Index:
    ids: list[int | None]
    width: int
    terms: np.ndarray
    most: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    start: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]


def question_and_answer(text: str) -> tuple[str, str]:
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    parts = re.split(r"(?<=[.?!])[ \t]+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _grams(text: str) -> np.ndarray:
    return np.unique(T.windows(T.word_hashes(text.encode().lower())))


def _starts(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_keys, np.arange(n + 1))


def build(items: list[tuple[int, str]], frequency: dict[int, int], n_items: int, mean: float) -> Index:
    """The index of one shard; ``frequency``, ``n_items`` and ``mean`` are those of all items."""
    words = [T.word_hashes(x.encode().lower()) for _, x in items]
    terms = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
    df = np.array([frequency[int(x)] for x in terms.view(np.int64)], dtype=np.float64)
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    at, item, weight = [], [], []
    for k, found in enumerate(words):
        own, tf = np.unique(found, return_counts=True)
        place = np.searchsorted(terms, own)
        w = idf[place] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(found) / mean))
        at.append(place)
        item.append(np.full(len(own), k))
        weight.append(w / w.sum())
    at, item, weight = np.concatenate(at), np.concatenate(item), np.concatenate(weight)
    order = np.lexsort((item, at))
    at, item, weight = at[order], item[order], weight[order]
    n_blocks = -(-len(items) // BLOCK_ITEMS)
    keys, back = np.unique(at * n_blocks + item // BLOCK_ITEMS, return_inverse=True)
    block_max, most = np.zeros(len(keys)), np.zeros(len(terms))
    np.maximum.at(block_max, back, weight)
    np.maximum.at(most, at, weight)
    parts = [question_and_answer(x) for _, x in items]
    return Index(
        [i for i, _ in items], max(map(len, words)), terms, most,
        _starts(keys // n_blocks, len(terms)), keys % n_blocks, block_max,
        _starts(at, len(terms)), item, weight,
        [_grams(q) for q, _ in parts], [_grams(a) for _, a in parts],
    )


def _spread(start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each posting of ``terms``: which of them it belongs to, and its place."""
    sizes = start[terms + 1] - start[terms]
    owner = np.repeat(np.arange(len(terms)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return owner, start[terms][owner] + np.arange(len(owner)) - first


def retrieve(index: Index, words: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(passage, item, score) of all items that a passage of these words reaches."""
    if not len(words) or not len(index.terms):
        return []
    place = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == words)
    term = place[known]
    n = max(1, -(-len(words) // index.width) - 1)  # passage p: words p * width to (p + 2) * width
    last = np.minimum(known // index.width, n - 1)
    before = known // index.width - 1
    both = (before >= 0) & (before < last)
    pairs = np.concatenate([last * len(index.terms) + term, (before * len(index.terms) + term)[both]])
    pairs = np.unique(pairs)
    passage, term = pairs // len(index.terms), pairs % len(index.terms)
    bound = np.bincount(passage, index.most[term], n)
    keep = bound[passage] >= threshold
    passage, term = passage[keep], term[keep]
    n_blocks, out = -(-len(index.ids) // BLOCK_ITEMS), []
    step = max(1, CELLS // n_blocks)
    for begin in range(0, n, step):
        a, b = np.searchsorted(passage, [begin, begin + step])
        if a == b:
            continue
        p, t = passage[a:b] - begin, term[a:b]
        owner, at = _spread(index.block_start, t)
        sums = np.bincount(p[owner] * n_blocks + index.block[at], index.block_max[at])
        open_blocks = np.flatnonzero(sums >= threshold)
        if not len(open_blocks):
            continue
        asked = np.isin(p, open_blocks // n_blocks)
        p, t = p[asked], t[asked]
        owner, at = _spread(index.start, t)
        cell = p[owner] * n_blocks + index.item[at] // BLOCK_ITEMS
        inside = np.isin(cell, open_blocks)
        key = p[owner][inside] * len(index.ids) + index.item[at][inside]
        found, back = np.unique(key, return_inverse=True)
        scores = np.bincount(back, index.weight[at][inside])
        for k in np.flatnonzero(scores >= threshold - 1e-9):
            out.append((begin + int(found[k]) // len(index.ids), int(found[k]) % len(index.ids), float(scores[k])))
    return out


def _share(grams: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(grams, there).mean()) if len(grams) else 1.0


def leaks(index: Index, words: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
    """(item, passage, score, question share, answer share) of the items that a text has leaked."""
    best: dict[int, tuple] = {}
    for passage, item, score in retrieve(index, words, threshold):
        part = words[passage * index.width : (passage + 2) * index.width]
        q, a = index.question[item], index.answer[item]
        sizes = {T.WORDS}  # shorter questions and answers are one gram of their own length
        if len(q) <= 1 or len(a) <= 1:
            sizes |= set(range(1, T.WORDS))
        there = np.concatenate([T.windows(part, n) for n in sizes])
        found = (item, passage, score, _share(q, there), _share(a, there))
        if found[3] >= overlap and found[4] >= overlap and score > best.get(item, (0, 0, 0))[2]:
            best[item] = found
    return list(best.values())


def by_length(
    items: list[tuple[int, str]], frequency: dict[int, int], n_items: int, mean: float
) -> list[Index]:
    """An index for each group of items of like length, with the statistics of all items."""
    groups: dict[int, list] = {}
    for item in items:
        words = len(T.word_hashes(item[1].encode().lower()))
        groups.setdefault(max(0, (-(-words // SHORT) - 1).bit_length()), []).append(item)
    return [build(group, frequency, n_items, mean) for _, group in sorted(groups.items())]


def _indexes(items: DataFrame):
    """The items in shards, each a list of indexes by length."""
    spark = items.sparkSession
    counted = items.filter("text IS NOT NULL")
    n = counted.count()
    shards = 1 if n <= SHARD else 2 * -(-n // SHARD)  # dealt by hash; half full on average
    counted = counted.withColumn("shard", F.expr(f"pmod(xxhash64(item_id, text), {shards})"))

    def terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [T.word_hashes(x.lower()) for x in T.bytes_of(batch.column(0))]
        flat = np.concatenate([np.unique(x) for x in found]).view(np.int64)
        sizes = np.concatenate([[len(x)] + [0] * (len(np.unique(x)) - 1) if len(x) else [] for x in found])
        return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(sizes.astype(np.int64))], ["term", "words"])

    rows = T.map_batches(counted.select("text"), terms, "term bigint, words bigint")
    rows = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("words").alias("words"))
    total = rows.agg(F.sum("words")).first()[0] or 0
    for shard in range(shards):
        part = counted.filter(F.col("shard") == shard)
        found = [(r.item_id, r.text) for r in part.select("item_id", "text").collect() if r.text.strip(" \t\n\r\x0b\x0c")]
        if not found:
            continue
        own = np.unique(np.concatenate([T.word_hashes(x.encode().lower()) for _, x in found])).view(np.int64)
        wanted = spark.createDataFrame([(int(x),) for x in own], "term bigint")
        frequency = {r.term: r.df for r in rows.join(wanted, "term", "left_semi").collect()}
        found.sort(key=lambda x: (x[0] is None, x))
        yield by_length(found, frequency, n, total / max(1, n))


SCHEMA = (
    "doc_id bigint, item_id bigint, start_word bigint, score double, question_overlap double, "
    "answer_overlap double"
)


def find(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """A row for each document and item that it has leaked, with the best passage's figures."""
    spark = docs.sparkSession
    docs = docs.select(T.ids(doc_id), T.ids(text, "text"))
    items = items.select(T.ids(item_id, "item_id").cast("bigint"), T.ids(item_text, "text"))

    def matches(indexes: list[Index]) -> DataFrame:
        shared = spark.sparkContext.broadcast(indexes)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, rows = batch.column(0).to_pylist(), []
            for at, words in T.texts_words([x.lower() for x in T.bytes_of(batch.column(1))]):
                for index in shared.value:
                    for item, passage, score, q, a in leaks(index, words, threshold, overlap):
                        rows.append((ids[at], index.ids[item], passage * index.width, score, q, a))
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            columns = [pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        return T.map_batches(docs, work, SCHEMA)

    return reduce(DataFrame.union, map(matches, _indexes(items)), spark.createDataFrame([], SCHEMA))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text has leaked no item, with all their columns."""
    threshold = options.get("threshold", THRESHOLD)
    overlap = options.get("overlap", OVERLAP)
    items = items.select(
        T.ids(options.get("item_id", "item_id"), "item_id").cast("bigint"),
        T.ids(options.get("item_text", "text"), "text"),
    )
    for indexes in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def keep(column: pa.Array, shared=shared) -> np.ndarray:
            out = np.ones(len(column), dtype=bool)
            for at, words in T.texts_words([x.lower() for x in T.bytes_of(column)]):
                out[at] = not any(leaks(index, words, threshold, overlap) for index in shared.value)
            return out

        docs = T.keep_rows(docs, text, keep)
    return docs
