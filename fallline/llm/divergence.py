"""How far the sources of a language differ in their words: exact counts in slots of perfect hashes.

1. A first pass counts, for each language, in how many rows a term occurs; terms of at least ``least`` rows
   are kept. The counts are exact: tasks hand on sums of what they have read.
2. The kept terms are dealt into shards of about ``SHARD`` terms and each shard is given a minimal perfect hash
   in a task of its own: buckets of terms, largest first, are displaced until each has free slots, and a
   bucket of one term names a free slot. The shard keeps its terms in the order of the slots.
3. The shards go to all tasks. In a second pass each distinct term of a batch is hashed to its slot, compared
   with the term stored there, and the slot in the dense array of its (language, source) is raised.
   Arrays are handed on when they outgrow their memory. At most ``MOST_TERMS`` terms of at most ``LONGEST`` bytes
   are sent, the most frequent ones; the rest are counted by term and joined with their slots.
4. The counts of a tile of slots and all sources of a language meet, and every two sources are
   compared over the slots of the tile; a term that a source lacks counts as well.

Null text, language and source are empty ones. A group without terms, a language that keeps none, ties, repeated
rows and ids, and very long texts are counted as they are; an empty table gives no rows. A language of S sources
has S * (S - 1) pairs, which is the size of the result. Extra columns are ignored.
"""

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .graph import staged

#: Rows of a language that a kept term occurs in at least, and the terms reported for a group.
LEAST, TOP = 10, 10
#: Terms of a shard, and terms and bytes of a term that are sent to all tasks at most.
SHARD, MOST_TERMS, LONGEST = 8192, 1_000_000, 64
#: Entries of a task's tables of words, and bytes of its dense arrays, before they are handed on.
ENTRIES, DENSE = 400_000, 64 << 20
BATCH = 16 << 20
#: Slots of a tile, and cells of a tile's matrix, at most.
TILE, CELLS = 1024, 1 << 22
#: Languages that are sent to all tasks at most.
MOST_LANGS = 100_000

_LETTERS = bytes(b if b > 0x7F else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def terms_of(data: bytes) -> list[bytes]:
    """Runs of letters and characters beyond ASCII, ``A-Z`` as ``a-z``."""
    return data.translate(_LETTERS).split()


def _codes(terms: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in terms], dtype=np.uint64)


def _slots(codes: np.ndarray, shift: np.ndarray, size) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (T.mixed(codes + shift.astype(np.uint64) * _STEP) % np.asarray(size, np.uint64)).astype(np.int64)


def perfect_hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of the buckets and the slot of each of ``codes``, which must differ.

    A displacement below 0 names the slot of a bucket's only code.
    """
    n = len(codes)
    buckets = max(1, ceil(n / 2))
    bucket = (codes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sizes = np.diff(ends)
    moves, slots, taken = np.zeros(buckets, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        members, first = order[ends[b] : ends[b + 1]], 0
        while True:
            shift = np.arange(first, first + 64)
            at = _slots(codes[members][None, :], shift[:, None], n)
            ordered = np.sort(at, axis=1)
            fits = ~taken[at].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                k = int(fits.argmax())
                moves[b], slots[members] = first + k, at[k]
                taken[at[k]] = True
                break
            first += 64
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(sizes == 1)
    moves[single], slots[order[ends[single]]] = -1 - free, free
    return moves, slots


class Index:
    """The shards of one language, one after the other; slots count through all of them."""

    def __init__(self, shards: list):
        n = shards[0].shards
        self.shards = np.uint64(n)
        # a shard that got no term leads to the first slot, whose term is another
        self.start, self.main = np.zeros(n, np.int64), np.ones(n, np.int64)
        self.moves = [np.array([-1])] * n
        for s in shards:
            self.start[s.shard], self.main[s.shard] = s.offset, s.main
            self.moves[s.shard] = np.array(s.moves, np.int64)
        self.bucket = np.concatenate([[0], np.cumsum([len(m) for m in self.moves])]).astype(np.int64)
        self.moves = np.concatenate(self.moves).astype(np.int64)
        keys = [k.encode() for s in shards for k in s.keys]
        self.width = max(map(len, keys))
        self.keys = np.array(keys, dtype=f"S{self.width}")

    def find(self, terms: list[bytes]) -> np.ndarray:
        """The slot of each term, -1 for terms that are not stored there."""
        codes = _codes(terms)
        shard = ((codes >> np.uint64(33)) % self.shards).astype(np.int64)
        buckets = (self.bucket[shard + 1] - self.bucket[shard]).astype(np.uint64)
        move = self.moves[self.bucket[shard] + (codes % buckets).astype(np.int64)]
        slot = np.where(move < 0, -1 - move, _slots(codes, np.maximum(move, 0), self.main[shard])) + self.start[shard]
        fits = np.fromiter(map(len, terms), np.int64, len(terms)) <= self.width
        fits &= self.keys[slot] == np.array(terms, dtype=f"S{self.width}")
        return np.where(fits, slot, -1)


def _frequencies(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, rows) of the terms in at least ``least`` rows of a language."""

    def given(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            if counts:
                terms = pa.array(counts, pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(terms), pa.string()), terms, pa.array(counts.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), T.bytes_of(batch.column(2))):
                held.setdefault(lang, Counter()).update(set(terms_of(data)))
            if sum(map(len, held.values())) > ENTRIES:
                yield from given(held)
                held = {}
        yield from given(held)

    T.batched(docs.sparkSession)
    counted = docs.mapInArrow(run, "lang string, term string, rows bigint")
    return counted.groupBy("lang", "term").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= least)


def _sent(kept: DataFrame, most: int) -> Column:
    """Whether a term goes to all tasks: it is short, and among the ``most`` most frequent ones."""
    short, band = F.octet_length("term") <= LONGEST, F.expr("CAST(floor(8 * log2(rows)) AS int)")
    rows = kept.filter(short).groupBy(band.alias("band")).count().collect()  # a few hundred at most
    least, held = 0, 0
    for row in sorted(rows, key=lambda r: -r.band):
        held += row["count"]
        if held > most:
            least = row.band + 1
            break
    return short & (band >= least)


def _shards(kept: DataFrame, most: int) -> DataFrame:
    """A row for each shard: its terms in the order of their slots, and its displacements."""

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = _codes(T.bytes_of(batch.column(1))).view(np.int64)
        return batch.append_column("code", pa.array(codes))

    kept = kept.select("lang", "term", _sent(kept, most).alias("sent"))
    sizes = kept.groupBy("lang", "sent").agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes"))
    sizes = sizes.selectExpr(
        "lang", "sent", f"greatest(ceil(n / {SHARD}), IF(sent, 0, ceil(bytes / {1 << 22}))) AS shards"
    )
    if sizes.limit(MOST_LANGS + 1).count() <= MOST_LANGS:
        sizes = F.broadcast(sizes)
    rows = T.map_batches(kept, coded, "lang string, term string, sent boolean, code bigint").join(sizes, ["lang", "sent"])
    rows = rows.withColumn("shard", F.expr("shiftrightunsigned(code, 33) % shards"))

    def work(key, table):
        terms = table.column("term").to_pylist()
        codes = table.column("code").to_numpy().view(np.uint64)
        moves, order = np.empty(0, np.int64), np.arange(len(terms))
        main = 0
        if key[1].as_py():
            # terms of one code cannot be told apart by it; all but one are counted by term
            first = np.unique(codes, return_index=True)[1]
            moves, slots = perfect_hash(codes[first])
            main, order = len(first), np.setdiff1d(order, first)
            order = np.concatenate([first[np.argsort(slots)], order])
        return pa.table(
            {
                "lang": [key[0].as_py()], "sent": [key[1].as_py()], "shard": [key[2].as_py()], "shards": [key[3].as_py()],
                "main": [main], "size": [len(terms)], "moves": pa.array([moves.tolist()], pa.list_(pa.int64())),
                "keys": [[terms[k] for k in order]],
            }
        )

    made = rows.groupBy("lang", "sent", "shard", "shards").applyInArrow(
        work,
        "lang string, sent boolean, shard bigint, shards bigint, main bigint, size bigint, moves array<bigint>, "
        "keys array<string>",
    )
    made = staged(made, "shards")
    whole = Window.partitionBy("lang")
    earlier = whole.orderBy(F.desc("sent"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = made.select("lang", "sent", "shard", "size").select(
        "lang", "sent", "shard", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"),
        F.sum("size").over(whole).alias("terms"),
    )
    return staged(made.join(offsets, ["lang", "sent", "shard"]), "shards")


def _recount(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, source, slot, term, count): by slot where the perfect hashes have the term, else by term."""
    parts: dict[str, list] = {}
    for row in shards.filter("sent").orderBy("lang", "offset").collect():
        parts.setdefault(row.lang, []).append(row)
    index = docs.sparkSession.sparkContext.broadcast({lang: Index(rows) for lang, rows in parts.items()})
    more = not shards.filter("main < size").isEmpty()

    def table(lang: str, source: str, slots, terms, counts) -> pa.RecordBatch:
        n = len(counts)
        columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), slots, terms, pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "slot", "term", "count"])

    def given(dense: dict, sparse: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in dense.items():
            at = np.flatnonzero(counts)
            yield table(lang, source, pa.array(at), pa.nulls(len(at), pa.string()), counts[at])
        for (lang, source), counts in sparse.items():
            terms = pa.array(counts, pa.binary()).cast(pa.string())
            yield table(lang, source, pa.nulls(len(terms), pa.int64()), terms, list(counts.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[tuple, np.ndarray] = {}
        sparse: dict[tuple, Counter] = {}
        for batch in batches:
            found: dict[tuple, Counter] = {}
            texts = T.bytes_of(batch.column(2))
            for lang, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                found.setdefault((lang, source), Counter()).update(terms_of(data))
            for group, counts in found.items():
                known = index.value.get(group[0])
                terms = list(counts)
                slots = known.find(terms) if known and terms else np.full(len(terms), -1)
                if known:
                    held = dense.get(group)
                    if held is None:
                        held = dense[group] = np.zeros(len(known.keys), np.int64)
                    here = slots >= 0
                    held[slots[here]] += np.fromiter(counts.values(), np.int64, len(terms))[here]
                if more:
                    rest = {terms[k]: counts[terms[k]] for k in np.flatnonzero(slots < 0)}
                    sparse.setdefault(group, Counter()).update(rest)
                if sum(x.nbytes for x in dense.values()) > DENSE or sum(map(len, sparse.values())) > ENTRIES:
                    yield from given(dense, sparse)
                    dense, sparse = {}, {}
        yield from given(dense, sparse)

    T.batched(docs.sparkSession, BATCH)  # each batch looks its terms up once
    return docs.mapInArrow(run, "lang string, source string, slot bigint, term string, count bigint")


def _share(count: str, total: str, terms: str) -> str:
    """A share in thousand millionths, one more than the exact whole number."""
    return (
        f"1 + CAST({count} + 2 AS decimal(20,0)) * CAST(1000000000 AS decimal(10,0)) "
        f"div CAST({total} + 2 * {terms} AS decimal(20,0))"
    )


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for every two groups of a language, by their numbers."""
    most = groups.agg(F.max("number")).first()[0]
    width = max(1, min(TILE, CELLS // most))
    tiles = groups.filter("number > 0").select(
        "lang", "number", "none", "terms", F.explode(F.expr(f"sequence(0L, greatest(0L, (terms - 1) div {width}))")).alias("tile")
    )

    def work(key, cells, sources):
        first = key[1].as_py() * width
        number = sources.column("number").to_numpy() - 1
        share = np.empty((len(number), min(width, sources.column("terms")[0].as_py() - first)), np.int64)
        share[number] = sources.column("none").to_numpy(zero_copy_only=False)[:, None]
        share[cells.column("at").to_numpy(), cells.column("slot").to_numpy() - first] = cells.column("share").to_numpy()
        a, b, values = [], [], []
        for k in range(len(number) - 1):
            apart = share[k + 1 :] - share[k]
            values.append((apart * apart // (share[k + 1 :] + share[k])).sum(axis=1))
            a.append(np.full(len(number) - 1 - k, k + 1))
            b.append(np.arange(k + 2, len(number) + 1))
        flat = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (a, b, values)]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(flat[0]), pa.string()), **dict(zip(("a", "b", "value"), flat))})

    cells = counts.select("lang", F.expr("number - 1").alias("at"), "slot", "share", F.expr(f"slot div {width}").alias("tile"))
    parts = cells.groupBy("lang", "tile").cogroup(tiles.groupBy("lang", "tile"))
    parts = parts.applyInArrow(work, "lang string, a bigint, b bigint, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least: int = LEAST,
    top: int = TOP,
    most_terms: int = MOST_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of a language by distance, and telling terms.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the source has
    more of than its language, each with its value.
    """
    plain = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    docs = docs.select(*plain, T.ids(text, "text"))
    kept = staged(_frequencies(docs, least), "kept")
    shards = _shards(kept, most_terms)
    found = staged(_recount(docs, shards), "found")
    names = shards.select("lang", "offset", "main", F.posexplode("keys").alias("k", "term"))
    names = names.selectExpr("lang", "offset + k AS slot", "term", "k >= main AS rest")
    rest = found.filter("term IS NOT NULL").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
    rest = rest.join(names.filter("rest"), ["lang", "term"]).select("lang", "source", "slot", "count")
    slots = found.filter("slot IS NOT NULL").select("lang", "source", "slot", "count").union(rest)
    counts = staged(slots.groupBy("lang", "source", "slot").agg(F.sum("count").alias("count")), "counts")

    # every group that occurs, and its language as number 0
    sizes = shards.groupBy("lang").agg(F.first("terms").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.selectExpr("lang", "source", "coalesce(total, 0L) AS total", "coalesce(terms, 0L) AS terms")
    numbers = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint")
    groups = groups.withColumn("number", numbers).withColumn(
        "none", F.expr(f"CASE WHEN terms > 0 THEN {_share('0', 'total', 'terms')} ELSE 0L END")
    )
    groups = staged(groups, "groups")
    if groups.isEmpty():
        return docs.selectExpr("lang", "source", "'' AS part", "'' AS item", "0L AS value", "0 AS rank").limit(0)
    counts = counts.join(groups, ["lang", "source"]).withColumn("share", F.expr(_share("count", "total", "terms")))

    # telling terms
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("terms").alias("terms"))
    common = counts.groupBy("lang", "slot").agg(F.sum("count").alias("count")).join(whole, "lang")
    common = common.select("lang", "slot", F.expr(_share("count", "total", "terms")).alias("common"))
    common = common.join(names.drop("rest"), ["lang", "slot"])
    telling = counts.join(common, ["lang", "slot"]).filter("share > common").selectExpr(
        "lang", "source", "'term' AS part", "term AS item",
        "(share - common) * (share - common) div (share + common) AS value",
    )

    # pairs, in both directions
    near = _pairs(counts, groups).selectExpr("lang", "value", "explode(array(struct(a, b), struct(b AS a, a AS b))) AS p")
    named = groups.select("lang", F.col("number"), "source")
    near = near.selectExpr("lang", "value", "p.a AS number", "p.b AS other").join(named, ["lang", "number"])
    other = named.selectExpr("lang", "number AS other", "source AS item")
    near = near.join(other, ["lang", "other"]).selectExpr("lang", "source", "'pair' AS part", "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(order)).union(telling)
