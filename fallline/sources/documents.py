"""Whole-document feature collections, cut into features by many tasks.

A document is one JSON value, so a task that reads a part of it does not know whether the part begins within
a string, or how deep. Two passes over the splits of the file settle that without moving any text:

1. Each split is summed up for both cases, begun outside and within a string: whether it has an odd number of
   quotes, and by how much braces and brackets grow. One row per split; the rows are composed by prefix, which gives
   every split the state that it begins in.
2. With its state, each split is cut at the objects that stand two braces deep in a list: the features. A
   feature that reaches over splits leaves a fragment in each, and fragments are put together by their order.

Files are read as records that end at ``{``, which Spark splits between tasks; a compressed file is one split.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fallline.session import materialize

#: Splits whose states are sent to all tasks at most; with splits of 128 MB, 128 TB of documents at once.
MOST_SPLITS = 1_000_000

#: A numbered part of a document is smaller than this, a terabyte.
PART_BYTES = 1 << 40

_QUOTE, _OPEN, _CLOSE, _LIST, _END = (ord(c) for c in '"{}[]')
_SUMMARY = "file bigint, split bigint, odd boolean, braces array<bigint>, brackets array<bigint>"
_PIECES = "file bigint, split bigint, number bigint, role string, text string"


def _records(spark: SparkSession, path: str | list[str], parts: bool) -> DataFrame:
    file, split = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if parts:  # the folder is the file, and a part's splits stand behind those of the parts before
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint")
        file, split = F.regexp_replace(file, "/[^/]*$", ""), part * PART_BYTES + split
    records = spark.read.option("lineSep", "{").text(path)
    return records.select("value", F.xxhash64(file).alias("file"), split.alias("split"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, bytes]]:
    """(split, whether it begins here, text): the records of a split put together again, batch by batch."""
    before = None
    for batch in batches:
        values = batch.column(0).cast(pa.binary()).to_pylist()
        keys = np.stack([batch.column(k).to_numpy() for k in (1, 2)])
        cuts = 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        for begin, end in zip([0, *cuts], [*cuts, len(values)]):
            if begin == end:
                continue
            key = (int(keys[0, begin]), int(keys[1, begin]))
            text = b"{".join(values[begin:end])
            # every record but the first of a file stands behind a brace
            yield key, key != before, text if key[1] % PART_BYTES == 0 and key != before else b"{" + text
            before = key


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places and kinds of braces and brackets, whether behind an odd number of quotes, and so the end."""
    if b"\\" in text:
        text = re.sub(rb"\\.", b"__", text, flags=re.DOTALL)
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((raw == _OPEN) | (raw == _CLOSE) | (raw == _LIST) | (raw == _END))
    quotes = np.flatnonzero(raw == _QUOTE)
    return at, raw[at], np.searchsorted(quotes, at) % 2 == 1, len(quotes) % 2 == 1


def _steps(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How each mark changes the depth in braces and in brackets."""
    braces = (kinds == _OPEN).astype(np.int64) - (kinds == _CLOSE)
    return braces, (kinds == _LIST).astype(np.int64) - (kinds == _END)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[tuple[int, int], list] = {}
    for key, begins, text in _texts(batches):
        row = rows[key] = [False, [0, 0], [0, 0]] if begins else rows[key]
        _, kinds, inside, odd = _marks(text)
        braces, brackets = _steps(kinds)
        for started in (0, 1):  # begun outside a string, or within one
            outside = inside if started ^ row[0] else ~inside
            row[1][started] += int(braces[outside].sum())
            row[2][started] += int(brackets[outside].sum())
        row[0] ^= odd
    columns = [[k[0] for k in rows], [k[1] for k in rows], *([r[n] for r in rows.values()] for n in range(3))]
    lists = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int64(), pa.bool_(), lists, lists)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in _SUMMARY.split(", ")])


def _states(summaries: DataFrame) -> DataFrame:
    """The state in which each split begins: within a string, and how many braces and brackets deep."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier), F.lit(0)) % 2
    begun = summaries.withColumn("inside", inside).select(
        "file", "split", "odd", F.col("inside") == 1,
        F.expr("element_at(braces, CAST(inside + 1 AS int)) AS braces"),
        F.expr("element_at(brackets, CAST(inside + 1 AS int)) AS brackets"),
    ).toDF("file", "split", "odd", "inside", "braces", "brackets")
    sums = [F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("braces", "brackets")]
    depths = [s.alias(f"{c}_before") for s, c in zip(sums, ("braces", "brackets"))]
    ends = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("split"))) == 1
    whole = (F.col("odd") == F.col("inside")) & (sums[0] + F.col("braces") == 0) & (sums[1] + F.col("brackets") == 0)
    return begun.select("file", "split", "inside", *depths, (ends & ~whole).alias("broken"))


class _Cutter:
    """Cuts the text of one split, handed over in chunks, at the features."""

    def __init__(self, inside: bool, braces: int, brackets: int):
        self.inside, self.braces, self.brackets = inside, braces, brackets
        #: Text of the object two braces deep that is open, and its role; the split may begin within one.
        self.open, self.role = bytearray(), "middle" if braces >= 2 else None
        self.between = False  # only features so far since the last feature
        self.pieces: list[tuple[str, bytes]] = []

    def add(self, text: bytes) -> None:
        at, kinds, inside, odd = _marks(text)
        outside = inside if self.inside else ~inside
        at, kinds = at[outside], kinds[outside]
        braces, brackets = _steps(kinds)
        depth, lists = self.braces + np.cumsum(braces), self.brackets + np.cumsum(brackets)
        done = 0
        turns = ((kinds == _OPEN) & (depth == 2)) | ((kinds == _CLOSE) & (depth == 1))
        for place, kind, deep in zip(at[turns].tolist(), kinds[turns].tolist(), lists[turns].tolist()):
            if kind == _OPEN:
                self.frame(text[done:place], deep == 1)
                self.role, done = "tail" if deep == 1 else "other", place
            else:
                self.open += text[done : place + 1]
                done = place + 1
                role = {"tail": "feature", "middle": "head" if deep == 1 else "last"}.get(self.role)
                if role:
                    self.pieces.append((role, bytes(self.open)))
                if role in (None, "last"):
                    self.pieces.append(("frame", b"{}"))
                self.between, self.role = deep == 1, None
                self.open.clear()
        if self.role:
            self.open += text[done:]
        else:
            self.frame(text[done:], False)
        if len(depth):
            self.braces, self.brackets = int(depth[-1]), int(lists[-1])
        self.inside ^= odd

    def frame(self, text: bytes, before_feature: bool) -> None:
        """What stands outside the objects; commas and white space beside features are left out."""
        if (self.between or before_feature) and not text.strip(b" \t\r\n,"):
            return
        self.between = False
        if text:
            self.pieces.append(("frame", text))

    def finish(self) -> list[tuple[str, bytes]]:
        if self.role:
            self.pieces.append((self.role, bytes(self.open)))
        return self.pieces


def _pieces(records: DataFrame, states: dict[tuple[int, int], tuple]) -> DataFrame:
    shared = records.sparkSession.sparkContext.broadcast(states)

    def batch(key: tuple[int, int], first: int, pieces: list[tuple[str, bytes]]) -> pa.RecordBatch:
        n = len(pieces)
        numbers = np.arange(first, first + n)
        texts = pa.array([t for _, t in pieces], pa.binary()).cast(pa.string())
        columns = [np.full(n, key[0]), np.full(n, key[1]), numbers, pa.array([r for r, _ in pieces], pa.string()), texts]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last, given = None, None, 0
        for key, begins, text in _texts(batches):
            if begins:
                if cutter:
                    yield batch(last, given, cutter.finish())
                cutter, last, given = _Cutter(*shared.value[key]), key, 0
            cutter.add(text)
            if cutter.pieces:
                yield batch(key, given, cutter.pieces)
                given += len(cutter.pieces)
                cutter.pieces = []
        if cutter:
            yield batch(last, given, cutter.finish())

    return records.mapInArrow(run, _PIECES)


def cut_features(spark: SparkSession, path: str | list[str], parts: bool = False) -> DataFrame:
    """The text of every feature (``line``) of the feature collections at ``path``.

    Documents of another type, and documents that end too early, fail the job. Objects in other lists of
    the document's top level count as features. The features are written to the shared folder once, so
    they may be read again. Documents are cut in any number of places; a feature is held whole. With
    ``parts`` each folder at ``path`` is one document in numbered parts, as Spark names the files it writes.
    """
    records = _records(spark, path, parts)
    rows = _states(materialize(records.mapInArrow(_summaries, _SUMMARY))).limit(MOST_SPLITS + 1).collect()
    if len(rows) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits; read fewer documents at once, or larger splits")
    if any(r.broken for r in rows):
        raise ValueError(f"not a whole JSON document among {path}")
    pieces = materialize(
        _pieces(records, {(r.file, r.split): (r.inside, r.braces_before, r.brackets_before) for r in rows})
    )

    # a feature over several splits: its fragments from one that begins an object up to the next such one
    parts = pieces.filter(F.col("role").isin("tail", "middle", "head", "other", "last"))
    order = Window.partitionBy("file").orderBy("split", "number")
    starts = F.sum(F.col("role").isin("tail", "other").cast("int")).over(order)
    joined = (
        parts.withColumn("object", starts).groupBy("file", "object")
        .agg(F.sort_array(F.collect_list(F.struct("split", "number", "role", "text"))).alias("parts"))
        .filter("parts[0].role = 'tail'").select(F.array_join("parts.text", "").alias("line"))
    )

    frames = pieces.filter("role = 'frame'").groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("split", "number", "text"))).alias("parts")
    )
    frame = F.regexp_replace(F.array_join("parts.text", ""), r"\[[\s,]*\]", "[]")
    kind = F.get_json_object(frame, "$.type")
    message = F.concat(F.lit("not a FeatureCollection: "), F.coalesce(kind, F.lit("no type")))
    good = F.when(kind == "FeatureCollection", F.lit(None)).otherwise(F.raise_error(message)).cast("string")
    checked = frames.select(good.alias("line")).filter("line IS NOT NULL")
    return pieces.filter("role = 'feature'").select(F.col("text").alias("line")).union(joined).union(checked)
