"""Substring dedup inside lines: passages of at least ``LEAST`` words that repeat, wherever they begin and however they are wrapped.

A text is the sequence of its words, whatever its case, lines and white space. Every ``LEAST`` consecutive words are a window.
The minhash of a window, by one hash function over its shingles of half as many words, is its one band. Equal windows
always share it, at the same place in the window. Neighbours whose minhash stands at one place are a stretch, of about 13 windows;
stretches whose band is found nowhere else leave before anything but bands has moved.

Stretches of one band that are equal as a whole are one kind. Where a band has one kind, its windows are repeats. Where it has several, as at the ends of a
passage, the windows of one stretch of each kind are compared, one by one. So the result is exact, as far as 64-bit hashes of words in a
band tell; copies are brought together by equal keys, never as pairs, and rows grow with the repeated words.

Of equal windows the first, by document and place, stays and the others are removals. A row is as many windows of a text one after the other as
stay, or are removals of the same first document. Rows next to each other share up to ``LEAST`` - 1 words.

Whole texts are read, very long ones too. Null and empty texts and those of fewer words have no passages. Rows
that repeat an id are documents of their own; the same row twice is a repetition. Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .graph import dropped, staged
from .ngram_join import among, filter_of, lists_of, passes

LEAST = 50
#: Windows whose minhashes are worked out together, and bits for a place among them.
HELD, PLACES = 1 << 16, 20


def minima(shingles: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` shingles one after the other, the place of the least by its high bits, the first of equal ones."""
    out = np.empty(max(0, len(shingles) - width + 1), np.int64)
    low = np.uint64((1 << PLACES) - 1)
    for k in range(0, len(out), HELD):
        least = shingles[k : k + HELD + width - 1] & ~low
        least |= np.arange(len(least), dtype=np.uint64)
        span = 1
        while span < width:  # the least of ever more neighbours
            step = min(span, width - span)
            least, span = np.minimum(least[:-step], least[step:]), span + step
        out[k : k + len(least)] = (least & low).astype(np.int64) + k
    return out


def _stretches(texts: list[bytes], least: int):
    """Hashed shingles of all ``texts`` after each other, and of each stretch: text, first window, windows, place of its band.

    With them the place at which each text begins.
    """
    words = [x for _, x in T.texts_words([x.lower() for x in texts])]
    sizes = np.array([len(x) for x in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = np.concatenate([np.empty(0, np.uint64), *words])
    if len(flat) < least:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4, begins
    shingles = T.windows(flat, -(-least // 2))
    bands = minima(shingles, least // 2 + 1)
    which = np.repeat(np.arange(len(texts)), sizes)
    windows = np.flatnonzero(which[: len(bands)] == which[least - 1 :])  # those within one text
    bands = bands[windows]
    new = np.flatnonzero(np.diff(bands, prepend=-1))
    first = windows[new]
    return shingles, which[first], first, np.diff(new, append=len(windows)), bands[new], begins


def _bands(docs: DataFrame, least: int) -> DataFrame:
    """(band, times): how many stretches of a batch have a band."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, *_, at, _ = _stretches(T.bytes_of(batch.column(0)), least)
        bands, times = np.unique(shingles[at], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(bands.view(np.int64)), pa.array(times)], ["band", "times"])

    return T.map_batches(docs.select("text"), work, "band bigint, times bigint")


#: What tells a kind of stretch: its band, the place of the band, how many windows it has, and all its words.
KIND = ["band", "lead", "size", "digest"]
FOUND = "row bigint, doc_id bigint, place bigint, band bigint, lead bigint, size bigint, digest bigint, codes array<bigint>"


def _found(docs: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """The stretches whose band passes the filter, with a code for each window."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    second = least // 2  # where the second half of a window begins

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, which, first, sizes, at, begins = _stretches(T.bytes_of(batch.column(1)), least)
        met = np.flatnonzero(passes(shared.value, shingles[at].view(np.int64)))
        which, first, sizes, at = which[met], first[met], sizes[met], at[met]
        ends = np.cumsum(sizes)
        windows = np.arange(sizes.sum()) + np.repeat(first - ends + sizes, sizes)
        with np.errstate(over="ignore"):
            # first and second half of the first window, and the second half of the last one, hold all words
            x, y, z = (shingles[k] for k in (first, first + second, first + sizes - 1 + second))
            digests = T.mixed((T.mixed(x * np.uint64(31) + y)) * np.uint64(31) + z)
            codes = T.mixed(shingles[windows] * np.uint64(31) + shingles[windows + second])
        codes = np.split(codes, ends[:-1]) if len(ends) else []
        known = [batch.column(k).take(pa.array(which)) for k in (0, 2)]
        numbers = first - begins[which], shingles[at].view(np.int64), at - first, sizes, digests.view(np.int64)
        columns = [known[1], known[0], *map(pa.array, numbers), lists_of(codes)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return T.map_batches(docs, work, FOUND)


def _pieces(found: DataFrame) -> DataFrame:
    """(KIND, skipped, n, doc, text_row, at): the windows of a kind that repeat, and where the first of the same words begin."""
    kinds = found.groupBy(*KIND).agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "row", "place")).alias("f"))
    kinds = staged(kinds.select(*KIND, "times", "f.*"), "kinds")
    bands = kinds.groupBy("band").agg(F.count("*").alias("kinds"), F.sum("times").alias("all")).filter("all > 1")
    kinds_met = staged(kinds.join(bands.select("band", "kinds"), "band"), "met")
    dropped(kinds)
    alone = kinds_met.filter("kinds = 1").selectExpr(*KIND, "0L AS skipped", "size AS n", "doc_id AS doc", "row AS text_row", "place AS at")
    # one stretch of each of the other kinds, window by window
    others = kinds_met.filter("kinds > 1").withColumn("id", F.xxhash64("row", "place"))
    codes = among(found.select(F.xxhash64("row", "place").alias("id"), "row", "place", "codes"), "id", others, "id")
    shown = codes.drop("id").join(others, ["row", "place"]).selectExpr(
        *KIND, "times", "doc_id", "row", "place", "posexplode(codes) AS (skipped, code)"
    )
    shown = staged(shown.withColumn("behind", F.expr("lead - skipped")).withColumn("at", F.expr("place + skipped")), "shown")
    same = ["band", "behind", "code"]
    firsts = shown.groupBy(*same).agg(F.sum("times").alias("all"), F.min(F.struct("doc_id", "row", "at")).alias("f"))
    firsts = firsts.filter("all > 1").selectExpr(*same, "f.doc_id AS doc", "f.row AS text_row", "f.at AS first_at")
    windows = shown.select(*KIND, "skipped", *same[1:]).join(firsts, same).withColumn("shift", F.expr("first_at - skipped"))
    key = [*KIND, "doc", "text_row", "shift"]
    run = F.col("skipped") - F.row_number().over(Window.partitionBy(*key).orderBy("skipped"))
    runs = windows.withColumn("run", run).groupBy(*key, "run").agg(
        F.min("skipped").cast("bigint").alias("skipped"), F.count("*").alias("n"), F.min("first_at").alias("at")
    )
    return alone.union(runs.select(*KIND, "skipped", "n", "doc", "text_row", "at"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """A row for each passage that has a copy: its place in words, and whether it is to go.

    ``first_doc`` is the document in which its windows occur first.
    """
    if least < 2:
        raise ValueError("a passage has two words at least")
    docs = docs.select(T.ids(doc_id).cast("bigint"), T.ids(text, "text"), F.monotonically_increasing_id().alias("row"))
    bands = _bands(docs, least).groupBy("band").agg(F.sum("times").alias("times"))
    met = staged(bands.filter("times > 1").select("band"), "bands")
    # the row's number is written with what is found in it
    found = staged(_found(docs, filter_of(met, "band"), least), "stretches")
    dropped(met)
    rows = found.select("row", "doc_id", "place", *KIND).join(_pieces(found), KIND).selectExpr(
        "row", "doc_id", "place + skipped AS begin", "n", "doc AS first_doc",
        "row <> text_row OR place + skipped <> at AS removed",
    )
    key = ["row", "doc_id", "first_doc", "removed"]
    order = Window.partitionBy(*key).orderBy("begin")
    new = F.expr("CAST(begin <> last AS int)")
    rows = rows.withColumn("last", F.lag(F.expr("begin + n")).over(order)).withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(order))
    runs = rows.groupBy(*key, "run").agg(F.min("begin").alias("first_word"), (F.sum("n") + least - 1).alias("n_words"))
    return runs.select("doc_id", "first_word", "n_words", "first_doc", "removed")
