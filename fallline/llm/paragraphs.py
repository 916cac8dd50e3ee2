"""Substring dedup: repeated paragraphs by MinHash banding.

A paragraph is a line of at least ``least_words`` words, by default as many as a shingle has. A run of at
least two consecutive lines of fewer than ``SHORT_WORDS`` words, none blank, is a paragraph too, so a passage
is found however it is wrapped. Equal ones, but for case and white space, are one class, told by 128 bits.

Each class has ``BANDS`` bands of ``ROWS`` minhashes of its word shingles, tuned for high recall: two classes of
similarity 0.8 share a band with a chance of 0.9998. In each band a class is held first against the least class and
against the next ``FOLLOWING`` ones in an order of the band's own; in families the bands of each class give it different
neighbours. Then all other pairs of a band whose classes are still in different components are held against each
other, by sizes and bitmaps in blocks inside tasks, and asked, so no pair that shares a band is left out.
Pairs are verified by
the exact Jaccard similarity of their texts and linked from ``threshold`` per cent on. A class that shares no
band leaves before any text moves. The components of the links are the clusters. A run in one component with a line of
its own is left to that line, since it is no repetition of it. Of each component the first paragraph, by
document and place, stays and the others are removals.

A run is numbered by its first line of ``least_words`` words, or by its first line if it has none;
``n_lines`` is 1 for a line. A passage inside a longer line, or a run whose neighbours are short lines as
well, may stay below the threshold.

Whole texts are read, very long ones too. Null and empty texts have no paragraphs. Rows that repeat an
id are documents of their own; the same row twice is a repetition. Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .graph import components, dropped, staged
from .ngram_join import (
    asked, bits_of, close_links, filter_of, groups_of, joined, listed, lists_of, pairs_within, passes, with_keys,
)

LEAST_WORDS = T.WORDS
#: Lines of fewer words, one after the other, are also taken together.
SHORT_WORDS = 25
THRESHOLD = 80
BANDS, ROWS = 16, 4
#: So many following members of a band is a class held against first. Any number gives the same clusters.
FOLLOWING = 4
#: Members of a band that are put in order together; a larger band is ordered in parts.
ORDERED = 100_000
#: Shingles whose hashes are worked out together.
SHINGLES = 1 << 15
_MASKS = T.seeds(BANDS * ROWS, 12000)[:, None]


def split(data: bytes, least_words: int):
    """(place, first line, number of lines, start byte, end byte, words) of the paragraphs of a text."""
    at = 0
    run: list[tuple[int, int, int, list[bytes]]] = []
    for place, line in enumerate(data.split(b"\n")):
        words = line.split()
        if not 0 < len(words) < SHORT_WORDS:
            yield from _run(run, least_words)
            run = []
        else:
            run.append((place, at, at + len(line), words))
        if len(words) >= max(1, least_words):
            yield place, place, 1, at, at + len(line), words
        at += len(line) + 1
    yield from _run(run, least_words)


def _run(lines: list[tuple[int, int, int, list[bytes]]], least_words: int):
    words = [x for *_, found in lines for x in found]
    if len(lines) > 1 and len(words) >= least_words:
        place = next((at for at, *_, found in lines if len(found) >= least_words), lines[0][0])
        yield place, lines[0][0], len(lines), lines[0][1], lines[-1][2], words


def class_of(words: list[bytes]) -> tuple[int, int]:
    """Two signed 64-bit numbers for a paragraph, whatever its case and white space."""
    both = xxhash.xxh3_128_intdigest(b" ".join(words).lower())
    return (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63)


FOUND = (
    "row bigint, doc_id bigint, paragraph int, first_line int, n_lines int, start bigint, end bigint, class bigint, more bigint"
)


def _found(docs: DataFrame, least_words: int) -> DataFrame:
    """Every paragraph, its place in code points, and its class."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, keys, ids = [], batch.column(2).to_pylist(), batch.column(0).to_pylist()
        for row, data in enumerate(T.bytes_of(batch.column(1))):
            # the place in code points of each place in bytes; of plain text, the same
            seen = None if data.isascii() else np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            for place, line, lines, start, end, words in split(data, least_words):
                if seen is not None:
                    start, end = (int(seen[x - 1]) if x else 0 for x in (start, end))
                found.append((keys[row], ids[row], place, line, lines, start, end, *class_of(words)))
        kinds = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.int64()] * 4
        columns = [pa.array(x, k) for x, k in zip(zip(*found) if found else [[]] * len(kinds), kinds)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return T.map_batches(docs, work, FOUND)


def minhashes(texts: list[bytes], words: int) -> np.ndarray:
    """The BANDS * ROWS minhashes of each text's word shingles, worked out together; a text has a word at least."""
    found = [x for _, x in T.texts_words([x.lower() for x in texts])]
    out = np.zeros((len(texts), BANDS * ROWS), np.uint64)
    counts = np.array([len(x) - words + 1 for x in found], np.int64)
    whole = np.flatnonzero(counts > 0)
    if len(whole):
        # windows over all texts, without those that reach over an end
        sizes = counts[whole] + words - 1
        last = np.repeat(np.cumsum(sizes) - words, sizes)
        flat = T.windows(np.concatenate([found[k] for k in whole]), words)
        flat = flat[np.arange(len(flat)) <= last[: len(flat)]]
        ends = np.cumsum(counts[whole])
        begin = 0
        while begin < len(whole):
            start = ends[begin] - counts[whole[begin]]
            end = max(begin + 1, int(np.searchsorted(ends, start + SHINGLES, "right")))
            some, at = flat[start : ends[end - 1]], ends[begin:end] - counts[whole[begin:end]] - start
            for k, mask in enumerate(_MASKS[:, 0]):
                out[whole[begin:end], k] = np.minimum.reduceat(some * (mask | np.uint64(1)) ^ mask, at)
            begin = end
    for k in np.flatnonzero(counts <= 0):  # fewer words than a shingle
        out[k] = (T.windows(found[k], words)[None, :] * (_MASKS | np.uint64(1)) ^ _MASKS).min(axis=1)
    return out


def _bands(docs: DataFrame, least_words: int, words: int) -> DataFrame:
    """(class, k, band): the bands of every class; a task gives each class that it meets in a batch once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = {}
        for data in T.bytes_of(batch.column(1)):
            for *_, found in split(data, least_words):
                texts.setdefault(class_of(found)[0], b" ".join(found))
        least = minhashes(list(texts.values()), words).reshape(-1, BANDS, ROWS)
        with np.errstate(over="ignore"):
            out = ((least[..., 0] * np.uint64(31) + least[..., 1]) * np.uint64(31) + least[..., 2]) * np.uint64(31) + least[..., 3]
        out = T.mixed(out)
        ks = np.tile(np.arange(BANDS, dtype=np.int32), len(texts))
        classes = np.repeat(np.fromiter(texts, np.int64, len(texts)), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(classes), pa.array(ks), pa.array(out.ravel().view(np.int64))], ["class", "k", "band"])

    return T.map_batches(docs, work, "class bigint, k int, band bigint")


def _pairs(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First pairs (a, b) of classes that share a band, with its least class and with the next ones.

    With them (class, k, band) of the bands that have more pairs than these.
    """
    ends = bands.groupBy("k", "band").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n"))
    ends = staged(ends.filter("least < most"), "ends")
    bits = bands.sparkSession.sparkContext.broadcast(filter_of(ends, "band"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(passes(bits.value, batch.column(2).to_numpy())))

    # a class comes once from each task that met it
    met = staged(T.map_batches(bands, work, bands.schema).distinct().join(ends, ["k", "band"]), "met")
    part = F.expr(f"pmod(xxhash64(class), ceil(n / {ORDERED}))")
    order = Window.partitionBy("k", "band", part).orderBy(F.xxhash64("class", "k"), "class")
    following = F.array("least", *[F.lead("class", k + 1).over(order) for k in range(FOLLOWING)])
    pairs = met.select(F.col("class").alias("a"), following.alias("others")).selectExpr("a", "explode(others) AS b")
    pairs = pairs.filter("a <> b")
    pairs = staged(pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "pairs")
    crowded = staged(met.filter(f"n > {FOLLOWING + 1}").select("class", "k", "band"), "crowded")
    dropped(ends, met)
    return pairs, crowded


def _apart(
    crowded: DataFrame, groups: DataFrame, pairs: DataFrame, texts: DataFrame, words: int, threshold: int
) -> tuple[DataFrame, DataFrame | None]:
    """The other pairs (a, b) of the ``crowded`` bands that are in different groups and may link; written.

    With them, written as well, the links of those among them that are too many to be listed, if any are.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for _, x in T.shingle_sets(T.bytes_of(batch.column(1)), words)]
        sizes = pa.array([len(x) for x in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, lists_of([bits_of(x) for x in found])], ["set_id", "n", "bits"])

    known = groups.selectExpr("set_id AS class", "group_id")
    rows = crowded.join(known, "class", "left").selectExpr("k", "band", "class AS set_id", "coalesce(group_id, class) AS group_id")
    split = rows.groupBy("k", "band").agg(F.min("group_id").alias("x"), F.max("group_id").alias("y"))
    rows = staged(rows.join(split.filter("x < y").select("k", "band"), ["k", "band"]), "split")
    wanted = rows.selectExpr("set_id AS class").distinct()
    facts = T.map_batches(
        texts.join(wanted, "class", "left_semi").select("class", "text"), work, "set_id bigint, n bigint, bits array<bigint>"
    )
    rows_known = listed(rows, ["k", "band"], "k").join(facts, "set_id").withColumn("rest", F.col("n"))
    near = pairs_within(rows_known, ["k", "band"], threshold).join(pairs, ["a", "b"], "left_anti")
    near = staged(near, "near")

    def sets(wanted: DataFrame) -> DataFrame:
        some = texts.join(wanted.withColumnRenamed("set_id", "class"), "class", "left_semi").select("class", "text", "more")
        return staged(T.map_batches(some, tokens, "set_id bigint, more bigint, tokens array<bigint>"), "whole")

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for _, x in T.shingle_sets(T.bytes_of(batch.column(1)), words)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists_of(found)], ["set_id", "more", "tokens"])

    close = near.filter("b IS NULL")
    links = None if close.isEmpty() else close_links(rows_known, close, sets, ["k", "band"], threshold)
    dropped(rows)
    return near, links


def _texts(docs: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """(class, more, text) of the ``wanted`` classes."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(wanted, "class"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = [], []
        for data in T.bytes_of(batch.column(1)):
            for *_, words in split(data, least_words):
                keys.append(class_of(words))
                texts.append(words)
        classes, more = (np.array(x, np.int64) for x in (zip(*keys) if keys else ((), ())))
        places = {keys[k]: k for k in np.flatnonzero(passes(bits.value, classes))}  # each class once
        at = np.fromiter(places.values(), np.int64, len(places))
        columns = [pa.array(classes[at]), pa.array(more[at]), pa.array([b" ".join(texts[k]).lower() for k in at], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["class", "more", "text"])

    found = T.map_batches(docs, work, "class bigint, more bigint, text string").dropDuplicates(["class", "more"])
    return found.join(wanted, "class", "left_semi")


def _linked(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """(a, a_more, b, b_more): the ``pairs`` (a, b) of classes whose texts are similar; written."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, dtype=bool)
        left, right = T.bytes_of(batch.column(4)), T.bytes_of(batch.column(5))
        a, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (more[1:] != more[:-1])])
        sets = [x for _, x in T.shingle_sets([left[k] for k in np.flatnonzero(new)], words)]
        which = np.cumsum(new) - 1
        for at, found in T.shingle_sets(right, words):
            held = sets[which[at]]
            both = len(np.intersect1d(held, found, assume_unique=True))
            keep[at] = 100 * both >= threshold * (len(held) + len(found) - both)
        return batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    joined = (
        pairs.join(texts.selectExpr("class AS b", "more AS b_more", "text AS right"), "b")
        .join(texts.selectExpr("class AS a", "more AS a_more", "text AS left"), "a")  # the same left texts one after the other
        .select("a", "a_more", "b", "b_more", "left", "right")
    )
    links = staged(T.map_batches(joined, work, "a bigint, a_more bigint, b bigint, b_more bigint"), "links")
    return links


def _links(docs: DataFrame, least_words: int, words: int, threshold: int) -> DataFrame:
    """(a, a_more, b, b_more): links that join all pairs of classes that share a band and whose texts are similar."""
    bands = staged(_bands(docs, least_words, words), "bands")
    pairs, crowded = _pairs(bands)
    dropped(bands)
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    texts = staged(_texts(docs, wanted, least_words), "texts")
    links = _linked(pairs, texts, words, threshold)
    groups = groups_of(links)
    near, more = _apart(crowded, groups, pairs, texts, words, threshold)
    dropped(pairs, crowded)
    groups, links = joined(groups, links, more)
    links = asked(near, groups, links, lambda asking: _linked(asking, texts, words, threshold))
    dropped(texts)
    return links


def repeated(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    words: int = T.WORDS,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """A row for each paragraph that has a copy: its place, its cluster, and whether it is to go.

    A cluster is named by its first paragraph (``first_doc``, ``first_paragraph``).
    """
    docs = docs.select(T.ids(doc_id).cast("bigint"), T.ids(text, "text"), F.monotonically_increasing_id().alias("row"))
    return _repeated(docs, least_words, words, threshold).drop("row")


def _repeated(docs: DataFrame, least_words: int = LEAST_WORDS, words: int = T.WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The same for ``docs`` (doc_id, text, row), with the row of each paragraph."""
    # the row's number is written with what is found in it
    found = staged(_found(docs, least_words), "paragraphs")
    links = _links(docs, least_words, words, threshold)
    # two classes may share their first 64 bits; then the second goes by its other ones
    classes = found.select("class", "more").distinct()
    shared = staged(classes.groupBy("class").agg(F.min("more").alias("least"), F.count("*").alias("n")).filter("n > 1"), "shared")
    twice = not shared.isEmpty()

    def node(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
        if not twice:
            return df.withColumn(name, F.col(first))
        known = shared.select(F.col("class").alias("_class"), F.col("least").alias("_least"))
        df = df.join(known, df[first] == known["_class"], "left")
        return df.withColumn(name, F.expr(f"IF({second} > _least, {second}, {first})")).drop("_class", "_least")

    pairs = node(node(links, "a", "a_more", "x"), "b", "b_more", "y").selectExpr("x AS a", "y AS b")
    groups = staged(components(pairs).selectExpr("node", "component"), "groups")
    dropped(links)
    sizes = node(found.groupBy("class", "more").agg(F.count("*").alias("n")), "class", "more", "node")
    sizes = sizes.join(groups, "node", "left").selectExpr("class", "more", "n", "coalesce(component, node) AS component")
    whole = sizes.groupBy("component").agg(F.sum("n").alias("n")).filter("n > 1").select("component")
    copied = staged(sizes.select("class", "more", "component").join(whole, "component"), "copied")
    rows = staged(found.join(copied, ["class", "more"]), "copied")
    dropped(found, groups, shared, copied)
    # a run and a line of its own are no two copies
    lines = rows.filter("n_lines = 1").selectExpr("row", "first_line AS line", "component")
    runs = rows.filter("n_lines > 1").selectExpr(
        "row", "first_line", "component", "explode(sequence(first_line, first_line + n_lines - 1)) AS line"
    )
    own = runs.join(lines, ["row", "line", "component"]).select("row", "first_line").distinct()
    own = own.withColumn("long", F.lit(True))
    rows = rows.withColumn("long", F.expr("n_lines > 1")).join(own, ["row", "first_line", "long"], "left_anti")
    place = F.struct("doc_id", "paragraph", "row", "n_lines")
    whole = rows.groupBy("component").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    same = F.expr("row = first.row AND paragraph = first.paragraph AND n_lines = first.n_lines")
    return rows.join(whole, "component").select(
        "row", "doc_id", "paragraph", "first_line", "n_lines", "start", "end", F.col("first.doc_id").alias("first_doc"),
        F.col("first.paragraph").alias("first_paragraph"), F.col("n").alias("copies"), (~same).alias("removed"),
    )


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with all columns, the removals cut out of ``text``, row by row whatever the ids.

    Of a run that is removed, a line stays that is itself the first of its copies.
    """
    docs, key = with_keys(docs)
    at, places = T.fresh(docs, "at"), T.fresh(docs, "places")
    found = _repeated(docs.select(T.ids(doc_id).cast("bigint"), T.ids(text, "text"), T.ids(key, "row")), **options)
    gone = found.groupBy(F.col("row").alias(at)).agg(
        F.expr("collect_set(CASE WHEN removed AND n_lines = 1 THEN paragraph END)").alias("lines"),
        F.expr("collect_set(CASE WHEN NOT removed AND n_lines = 1 THEN paragraph END)").alias("kept"),
        F.expr(
            "flatten(collect_list(CASE WHEN removed AND n_lines > 1 "
            "THEN sequence(first_line, first_line + n_lines - 1) END))"
        ).alias("runs"),
    )
    gone = gone.select(at, F.expr("array_union(lines, array_except(runs, kept))").alias(places))
    lines = F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains(places, k))
    cut = F.when(F.col(places).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))
    return docs.join(gone, docs[key] == gone[at], "left").withColumn(text, cut).drop(at, places, key)
