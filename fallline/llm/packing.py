"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

A bin carries what it has room for, a bitmap of its duplicate clusters, and bitmaps of its
sources. A piece goes, largest first, to the tightest bin that it fits and that it does not
conflict with: the successor search goes on from the smallest sufficient room upwards until a bin is
compatible, and opens a new bin if none is. Two documents of one duplicate cluster never
share a bin, and a bin has at most ``per_source`` pieces of one source.

Sizes are words. A text longer than a bin is cut into pieces; every word is packed once. Pieces are
dealt by hash into shards of about ``SHARD`` pieces that are packed on their own, so no task
sees more, whatever source or cluster holds most of the rows; copies spread evenly over the shards.
Null and empty texts are one piece of no words. A null source or cluster conflicts with nothing. Rows
that repeat an id are packed each.
"""

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import staged

CAPACITY, PER_SOURCE, SHARD = 2048, 4, 4096


def best_fit(
    pieces: Iterable[tuple[int, int, int]], capacity: int, per_source: int
) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each piece (size, source bit, cluster bit), in order; a bit may be 0."""
    rooms: list[tuple[int, int]] = []  # (room, bin), ordered
    clusters: list[int] = []
    sources: list[list[int]] = []  # for each bin: sources that it has more than k times, by k
    for size, source, cluster in pieces:
        k = bisect_left(rooms, (size, -1))
        while k < len(rooms):
            b = rooms[k][1]
            if not (clusters[b] & cluster or sources[b][-1] & source):
                break
            k += 1
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * per_source)
        clusters[b] |= cluster
        for level, seen in enumerate(sources[b]):
            if not seen & source:
                sources[b][level] |= source
                break
        insort(rooms, (room - size, b))
        yield b, capacity - room


SCHEMA = "doc_id bigint, piece int, start_word bigint, n_words bigint, bin_id bigint, bin_offset bigint"


def _sizes(docs: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([len(x.split()) for x in T.bytes_of(batch.column("text"))], pa.int64())
        kept = batch.drop_columns(["text"])
        return kept.append_column("n_words", n)

    return T.map_batches(docs, work, "doc_id bigint, source string, cluster bigint, n_words bigint")


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard: int = SHARD,
) -> DataFrame:
    """Bin and offset of every piece of every row. ``cluster`` is a bigint; by default, equal texts."""
    if cluster is None:
        cluster = F.when(F.col(text) != "", F.xxhash64(text))
    docs = docs.select(
        T.ids(doc_id).cast("bigint"), T.ids(source, "source").cast("string"), cluster.alias("cluster"), T.ids(text, "text")
    )
    return pack_sized(_sizes(docs), capacity, per_source, shard)


def pack_sized(sized: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """The same for rows (doc_id, source, cluster, n_words)."""
    # the row's number is written with it, so that dealing a task anew deals the same
    sized = staged(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    pieces = sized.selectExpr(
        "*", f"explode(sequence(0L, greatest(0L, (n_words - 1) div {capacity}))) AS piece"
    ).selectExpr(
        "row", "doc_id", "source", "cluster", "CAST(piece AS int) AS piece", f"piece * {capacity} AS start_word",
        f"least({capacity}, n_words - piece * {capacity}) AS size",
    )
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.expr(f"pmod(xxhash64(row, piece), {shards}L)"))

    def work(table: pa.Table) -> pa.Table:
        order = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bits: tuple[dict, dict] = ({}, {})

        def bit(kind: int, value) -> int:
            return 0 if value is None else 1 << bits[kind].setdefault(value, len(bits[kind]))

        rows = zip(*(order.column(x).to_pylist() for x in ("size", "source", "cluster")))
        found = list(best_fit(((n, bit(0, s), bit(1, c)) for n, s, c in rows), capacity, per_source))
        first = order.column("shard")[0].as_py() << 32
        return pa.table(
            {
                "doc_id": order.column("doc_id"),
                "piece": order.column("piece"),
                "start_word": order.column("start_word"),
                "n_words": order.column("size"),
                "bin_id": pa.array([first + b for b, _ in found], pa.int64()),
                "bin_offset": pa.array([x for _, x in found], pa.int64()),
            }
        )

    return dealt.groupBy("shard").applyInArrow(work, SCHEMA)
