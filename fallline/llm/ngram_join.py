"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct word shingles. Two sets link when 100 times their intersection
is at least ``threshold`` times their union. The result is exact: every document gets the least
document id that it reaches over links.

1. Equal sets become one set. Sets that share a band of minhashes with a leader are compared with it
   and, where they link, joined to groups of similar sets. This only groups; it decides no non-link.
2. The matrix holds, for each shingle, the groups that it occurs in. Only the shingles that can
   decide are looked at: linked sets share one of the first ``n - ceil(t n) + 1`` shingles of
   either in any common order. The order is by hash with frequent shingles last, so a line
   that many documents share leads nowhere. Groups that meet at frequent shingles are merged first, in
   rounds of a few comparisons a set, so a family of near copies is one group. Where the first shared
   shingle stands bounds the overlap as well.
3. Sets that meet at a shingle and are still in different groups are held against each other, at a frequent shingle
   in blocks inside tasks: a set moves once for each block, not once for each partner. Sizes, the place
   of the shingle and bitmaps of hashed shingles bound the overlap from above; only pairs whose bound allows a link
   leave the task, each at its first shared shingle. Where they are many for the rows, whole sets are compared
   inside tasks instead, and links that join all that link leave: fewer than rows.
4. Those are asked by whole texts, first one pair of each two groups, then all that are still in different
   components. Nothing is left out.

Nulls, empty texts and texts of white space have no shingles and link with nothing. A text with fewer
words than a shingle is one shingle. Rows that repeat an id are separate texts; a null id is never the
least one unless the component has no other. Extra columns are ignored.
"""

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from . import text as T
from .graph import components, dropped, staged, stars

BANDS, ROWS = 6, 2
#: A shingle in more sets than this comes last in the order. Any number gives the same links.
FREQUENT = 64
#: At most so many frequent shingles go to the tasks; beyond, FREQUENT is doubled.
MOST_FREQUENT = 250_000
#: Groups at frequent shingles are merged while they make more than so many pairs for a row of the matrix.
MERGED = 1
#: Sets at a shingle that are paired one by one; more are held against each other in blocks of this size.
PAIRED, BLOCK = 16, 1024
#: Pairs for a row that two blocks name at most; where there are more, their sets are compared as a whole inside tasks.
CLOSE = 16
#: Shingles in a block of whole sets, beyond which it is cut.
HELD_SHINGLES = 1 << 18
#: Earlier keys that a row carries, so that a pair is named once. Any number gives the same links.
LISTED = 32
#: So many pairs of two groups are asked before all of them are.
DRAWN = 8
#: Pairs for a set that are all asked at once; where there are more, one of each two groups comes first.
ASKED = 2
#: Pairs for a set up to which whole texts are asked without bitmaps before.
FEW = 0.25
#: Numbers in the largest array with which two blocks are compared.
CELLS = 1 << 20
#: Bits for a value, and most bits, of the filters that spare rows a shuffle; a full one lets all pass.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 26
_MASKS = T.seeds(BANDS * ROWS, 9000)[:, None]


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-n * threshold // 100) + 1


def bits_of(tokens: np.ndarray) -> np.ndarray:
    """A bitmap with at least four bits a shingle."""
    words = 1 << max(0, ceil(np.log2(max(1, len(tokens) / 16))))
    bits = np.zeros(words, dtype=np.uint64)
    at = tokens & np.uint64(words * 64 - 1)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


SKETCH = (
    "doc_id bigint, digest bigint, set_id bigint, n bigint, bands array<bigint>, "
    "bits array<bigint>, tokens array<bigint>, n_words bigint"
)


def _sketches(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """For each row: its set, minhash bands, bitmap, the shingles that come first by hash, its words; then its columns behind ``text``."""
    carried = docs.columns[3:]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        sets, sizes, counts = np.zeros(rows, np.uint64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        bands, bits, tokens = [[np.empty(0, np.uint64)] * rows for _ in range(3)]
        for at, held in T.texts_words([x.lower() for x in T.bytes_of(batch.column(2))]):
            found = T.distinct(T.windows(held, words))
            n, counts[at] = len(found), len(held)
            if not n:
                continue
            with np.errstate(over="ignore"):
                sets[at] = T.mixed(np.uint64(n) + np.sum(T.mixed(found), dtype=np.uint64)[None])[0]
                least = (found[None, :] * (_MASKS | np.uint64(1)) ^ _MASKS).min(axis=1)
                pairs = least.reshape(BANDS, ROWS)
                bands[at] = T.mixed(pairs[:, 0] * np.uint64(31) + pairs[:, 1])
            sizes[at], bits[at] = n, bits_of(found)
            tokens[at] = found[: prefix_length(n, threshold) + 8 + n // 20]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sets.view(np.int64)),
             pa.array(sizes), lists_of(bands), lists_of(bits), lists_of(tokens), pa.array(counts), *batch.columns[3:]],
            ["doc_id", "digest", "set_id", "n", "bands", "bits", "tokens", "n_words", *carried],
        )

    return T.map_batches(docs, work, ", ".join([SKETCH, *(f"{x} {docs.schema[x].dataType.simpleString()}" for x in carried)]))


def filter_of(values: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A bitmap of hashed values, of at most MOST_FILTER_BITS bits however many values there are."""
    if bits is None:
        wanted = min(MOST_FILTER_BITS, max(1 << 16, FILTER_BITS * values.count()))
        bits = 1 << (wanted - 1).bit_length()
    rows = (
        values.selectExpr(f"pmod({column}, {bits}) AS p")
        .groupBy(F.expr("p div 32768").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
        .collect()
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows:
        out[row.bucket * 4096 : (row.bucket + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _first(tokens: np.ndarray, n: int, threshold: int, frequent: np.ndarray):
    """Places in ``tokens`` of the deciding shingles, or None where more of the set must be known."""
    need = prefix_length(n, threshold)
    if not len(frequent):
        return np.arange(need)
    k = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    often = frequent[k] == tokens
    rare = np.flatnonzero(~often)[:need]
    if len(rare) == need:
        return rare
    if len(tokens) < n:
        return None
    return np.concatenate([rare, np.flatnonzero(often)[: need - len(rare)]])


def _matrix_rows(sets: DataFrame, threshold: int, frequent: np.ndarray, wanted: np.ndarray | None,
                 changed_only: bool = False) -> DataFrame:
    """(token, set_id, n, rest) of the deciding shingles of ``sets`` that pass the filter ``wanted``.

    ``rest`` counts the set's shingles from this one on, in the common order. ``changed_only`` gives only those that the frequent shingles moved up. A set of which too little
    is known gives one row with a null token.
    """
    context = sets.sparkSession.sparkContext
    shared = context.broadcast((frequent, wanted))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        often, bits = shared.value
        lists = batch.column(2)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out_tokens, out_rows, out_rest, unknown = [], [], [], []
        for row, n in enumerate(sizes):
            if not n:
                continue
            tokens = flat[ends[row] : ends[row + 1]]
            first = _first(tokens, n, threshold, often)
            if first is None:
                unknown.append(row)
                continue
            rest = n - np.arange(len(first))
            if changed_only:
                moved = first >= prefix_length(n, threshold)
                first, rest = first[moved], rest[moved]
            found = tokens[first]
            if bits is not None:
                met = passes(bits, found)
                found, rest = found[met], rest[met]
            if len(found):
                out_tokens.append(found)
                out_rest.append(rest)
                out_rows.append(np.full(len(found), row))
        at = np.concatenate([*out_rows, unknown]).astype(np.int64)
        tokens = np.concatenate([*out_tokens, np.zeros(len(unknown), np.uint64)]).view(np.int64)
        rest = np.concatenate([*out_rest, np.zeros(len(unknown))]).astype(np.int64)
        missing = np.arange(len(at)) >= len(at) - len(unknown)
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens, mask=missing), pa.array(ids[at]), pa.array(sizes[at]), pa.array(rest)],
            ["token", "set_id", "n", "rest"],
        )

    picked = sets.select("set_id", "n", "tokens")
    return T.map_batches(picked, work, "token bigint, set_id bigint, n bigint, rest bigint")


def among(df: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` that may have a partner in ``wanted``: a join then shuffles little else."""
    bits = df.sparkSession.sparkContext.broadcast(filter_of(wanted, key))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(passes(bits.value, batch.column(column).to_numpy())))

    return T.map_batches(df, work, df.schema)


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, text) of the ``wanted`` sets (set_id)."""
    keys = among(sets.select("set_id", "digest"), "set_id", wanted, "set_id")
    keys = staged(keys.join(wanted, "set_id", "left_semi"), "keys")
    near = among(docs.select("digest", "text"), "digest", keys, "digest").dropDuplicates(["digest"])
    texts = staged(near.join(keys, "digest").select("set_id", "text"), "texts")
    dropped(keys)
    return texts


def _linked(
    pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, threshold: int
) -> DataFrame:
    """The pairs (a, b) of sets that link, by their whole texts; written."""
    wanted = staged(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct(), "wanted")
    texts = _texts(docs, sets, wanted)
    dropped(wanted)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, dtype=bool)
        ids = batch.column(0).to_numpy()
        left, right = T.bytes_of(batch.column(2)), T.bytes_of(batch.column(3))
        last, held = None, None
        for at, found in T.shingle_sets(right, words):
            if ids[at] != last:
                last, held = ids[at], next(T.shingle_sets([left[at]], words))[1]
            both = len(np.intersect1d(held, found, assume_unique=True))
            keep[at] = 100 * both >= threshold * (len(held) + len(found) - both)
        return batch.select(["a", "b"]).filter(pa.array(keep))

    joined = (
        pairs.join(texts.selectExpr("set_id AS b", "text AS right"), "b")
        .join(texts.selectExpr("set_id AS a", "text AS left"), "a")
        .select("a", "b", "left", "right")
    )
    links = staged(T.map_batches(joined, work, "a bigint, b bigint"), "links")
    dropped(texts)
    return links


def _allowed(rows: DataFrame, threshold: int, columns: list[str], schema: str) -> DataFrame:
    """The rows whose bitmaps allow a link: ``q_bits`` of a set of q_n shingles, ``g_bits`` of a set of g_n."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, dtype=bool)
        names = batch.schema.names
        left, right = (batch.column(names.index(x)) for x in ("q_bits", "g_bits"))
        q_n, g_n = (batch.column(names.index(x)).to_numpy() for x in ("q_n", "g_n"))
        for at in range(batch.num_rows):
            q = left[at].values.to_numpy().view(np.uint64)
            g = right[at].values.to_numpy().view(np.uint64)
            size = min(len(q), len(g))
            q, g = _folded([q], size)[0], _folded([g], size)[0]
            most = q_n[at] - int(np.bitwise_count(q & ~g).sum())
            most = min(most, g_n[at] - int(np.bitwise_count(g & ~q).sum()))
            # 100 * both >= threshold * (q_n + g_n - both), with the most that both can be
            keep[at] = (100 + threshold) * most >= threshold * (q_n[at] + g_n[at])
        return batch.select(columns).filter(pa.array(keep))

    return T.map_batches(rows, work, schema)


def _sizes_fit(a: str, b: str, threshold: int) -> str:
    return f"100 * {a} >= {threshold} * {b} AND 100 * {b} >= {threshold} * {a}"


def _leaders(sketches: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of a set and a leader that shares bands with it; at most two for a set."""
    bands = sketches.filter("n > 0").selectExpr("set_id", "n", "posexplode(bands) AS (k, band)")
    ends = bands.groupBy("k", "band").agg(
        F.min(F.struct("set_id", "n")).alias("x"), F.max(F.struct("set_id", "n")).alias("y")
    )
    ends = ends.filter("x.set_id < y.set_id").selectExpr("k", "band", "explode(array(x, y)) AS l")
    met = (
        bands.join(ends, ["k", "band"])
        .filter("set_id <> l.set_id AND " + _sizes_fit("n", "l.n", threshold))
        .groupBy("set_id", F.col("l.set_id").alias("leader"))
        .agg(F.count_distinct("k").alias("times"))
    )
    best = met.groupBy("set_id").agg(
        F.max(F.struct("times", "leader")).alias("x"), F.min("leader").alias("y")
    )
    pairs = best.selectExpr("set_id", "explode(array_distinct(array(x.leader, y))) AS leader")
    return pairs.selectExpr("least(set_id, leader) AS a", "greatest(set_id, leader) AS b").distinct()


def _verified(
    pairs: DataFrame, facts: DataFrame, docs: DataFrame, sets: DataFrame, words: int, threshold: int
) -> DataFrame:
    """The written ``pairs`` (a, b) that link: bitmaps first unless few, then whole texts. ``pairs`` is deleted."""
    if pairs.count() <= FEW * facts.count():
        links = _linked(pairs, docs, sets, words, threshold)
        dropped(pairs)
        return links
    wanted = pairs.selectExpr("explode(array(a, b)) AS set_id")
    known = among(facts, "set_id", wanted, "set_id")
    near = (
        pairs.join(known.selectExpr("set_id AS a", "n AS q_n", "bits AS q_bits"), "a")
        .join(known.selectExpr("set_id AS b", "n AS g_n", "bits AS g_bits"), "b")
        .select("a", "b", "q_n", "q_bits", "g_n", "g_bits")
    )
    near = staged(_allowed(near, threshold, ["a", "b"], "a bigint, b bigint"), "near")
    dropped(pairs)
    links = _linked(near, docs, sets, words, threshold)
    dropped(near)
    return links


def groups_of(links: DataFrame) -> DataFrame:
    """(set_id, group_id, members) of the components of ``links``; written."""
    found = stars(links)
    size = found.groupBy(F.col("b").alias("group_id")).agg((F.count("*") + 1).alias("members"))
    leaves = found.selectExpr("a AS set_id", "b AS group_id").join(size, "group_id")
    sized = leaves.select("set_id", "group_id", "members").union(size.selectExpr("group_id AS set_id", "group_id", "members"))
    return staged(sized, "groups")


def _gathered(
    rows: DataFrame, groups: DataFrame, links: DataFrame, facts: DataFrame, docs: DataFrame, sets: DataFrame,
    words: int, threshold: int, frequent: int,
) -> tuple[DataFrame, DataFrame]:
    """``groups`` and ``links`` with the groups merged that meet at shingles of more than ``frequent`` sets.

    In a round, each set at such a shingle is held against one set of the shingle's largest group and one
    of any group, both drawn by a hash that changes with the round, and of all it meets so against the two
    met most often. A family of near copies comes together this way at a cost that grows with its rows, not with
    its pairs. Rounds end when the pairs of sets and groups left are few against the rows, or fell by less than a
    quarter; what is still apart is asked by the matrix, so the rounds decide no non-link.
    """
    often = rows.groupBy("token").count().filter(f"count > {frequent}").select("token")
    crowded = staged(rows.join(often, "token").select("token", "set_id", "n"), "crowded")
    few, before, number = MERGED * rows.count(), None, 0
    while True:
        met = staged(_grown(crowded, groups), "met")
        per_token = met.groupBy("token", "group_id").count().groupBy("token").agg(F.count("*").alias("g"))
        cost = per_token.agg(F.sum(F.expr("CAST(g AS double) * (g - 1) / 2"))).first()[0] or 0
        if cost <= few or (before is not None and cost > 0.75 * before):
            dropped(met)
            break
        before, number = cost, number + 1
        drawn = F.xxhash64("set_id", F.lit(number))
        heads = met.groupBy("token").agg(
            F.max(F.struct("members", drawn.alias("h"), "set_id", "n", "group_id")).alias("x"),
            F.min(F.struct(drawn.alias("h"), "members", "set_id", "n", "group_id")).alias("y"),
        )
        heads = heads.selectExpr(
            "token",
            "explode(array(struct(x.set_id, x.n, x.group_id), struct(y.set_id, y.n, y.group_id))) AS head",
        )
        held = (
            met.join(heads, "token")
            .filter("group_id <> head.group_id AND " + _sizes_fit("n", "head.n", threshold))
            .groupBy("set_id", F.col("head.set_id").alias("head")).agg(F.count("*").alias("times"))
        )
        best = held.groupBy("set_id").agg(
            F.max(F.struct("times", "head")).alias("x"),
            F.max(F.struct(F.xxhash64("head", F.lit(number)), "head")).alias("y"),
        )
        pairs = best.selectExpr("set_id", "explode(array_distinct(array(x.head, y.head))) AS head")
        pairs = pairs.selectExpr("least(set_id, head) AS a", "greatest(set_id, head) AS b").distinct()
        pairs = staged(pairs, "heads")
        dropped(met)
        more = _verified(pairs, facts, docs, sets, words, threshold)
        if more.isEmpty():
            dropped(more)
            break
        last, links = links, staged(links.union(more), "links")
        dropped(last, more, groups)
        groups = groups_of(links)
    dropped(crowded)
    return groups, links


def _grown(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the group of their set and its size; a set without links is its own group."""
    return rows.join(groups, "set_id", "left").selectExpr(
        *rows.columns, "coalesce(group_id, set_id) AS group_id", "coalesce(members, 1) AS members"
    )


def similar(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = T.WORDS,
    threshold: int = 80,
    frequent: int = FREQUENT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    docs = docs.select(T.ids(doc_id).cast("bigint"), T.ids(text, "text"))
    rows = _components(docs, ["doc_id", "n"], words, threshold, frequent)
    least = rows.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (
        rows.filter("n > 0").join(least, "component").select("doc_id", "n", "component_id")
        .union(rows.filter("n = 0").selectExpr("doc_id", "n", "doc_id AS component_id"))
        .withColumnRenamed("n", "n_shingles")
    )


def _components(docs: DataFrame, kept: list[str], words: int, threshold: int, frequent: int) -> DataFrame:
    """The columns ``kept`` of each row of ``docs`` (doc_id, text, and others) and its sketch, with its component."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text", *docs.columns[2:])
    sketches = staged(_sketches(docs, words, threshold), "sketches")
    owners = staged(sketches.select("set_id", *kept), "owners")
    sets = staged(
        sketches.filter("n > 0").select("set_id", "n", "bits", "doc_id", "digest").dropDuplicates(["set_id"]),
        "sets",
    )

    # the shingles that more than one set has among those that come first
    none = np.empty(0, np.uint64)
    met = (
        _matrix_rows(sketches, threshold, none, None)
        .groupBy("token").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y"))
        .filter("x < y").select("token")
    )
    met = staged(met, "shared")
    shared = filter_of(met, "token")
    dropped(met)
    rows = staged(_matrix_rows(sketches, threshold, none, shared).distinct(), "matrix")
    counts = rows.groupBy("token").count()
    while counts.filter(f"count > {frequent}").limit(MOST_FREQUENT + 1).count() > MOST_FREQUENT:
        frequent *= 2
    often = [r.token for r in counts.filter(f"count > {frequent}").select("token").collect()]
    if often:
        often = np.sort(np.array(often, dtype=np.int64).view(np.uint64))
        # with those last, other shingles move up; their partners are looked for as well
        moved = _matrix_rows(sketches, threshold, often, None, changed_only=True)
        unknown = moved.filter("token IS NULL").select("set_id").distinct()
        texts = _texts(docs, sets, unknown)
        whole = staged(_whole_sets(texts, words), "whole")
        dropped(texts)
        moved = moved.filter("token IS NOT NULL").select("token").union(
            _matrix_rows(whole, threshold, often, None).select("token")
        )
        wanted = shared | filter_of(moved, "token", 8 * len(shared))
        known = _matrix_rows(sketches, threshold, often, wanted).filter("token IS NOT NULL")
        last, rows = rows, staged(known.union(_matrix_rows(whole, threshold, often, wanted)).distinct(), "matrix")
        dropped(last, whole)

    # groups of similar sets
    pairs = staged(_leaders(sketches, threshold), "leaders")
    dropped(sketches)
    facts = sets.select("set_id", "n", "bits")
    links = _verified(pairs, facts, docs, sets, words, threshold)
    groups, links = _gathered(rows, groups_of(links), links, facts, docs, sets, words, threshold, frequent)

    # sets that meet at a shingle and are still apart
    def whole_sets(wanted: DataFrame) -> DataFrame:
        texts = _texts(docs, sets, wanted)
        found = staged(_whole_sets(texts, words).withColumn("more", F.lit(0).cast("bigint")), "whole")
        dropped(texts)
        return found

    near, more = _near(_grown(rows, groups), facts, whole_sets, threshold)
    dropped(rows)
    groups, links = joined(groups, links, more)
    links = asked(near, groups, links, lambda pairs: _linked(pairs, docs, sets, words, threshold), ASKED * sets.count())

    # components of sets, and of documents
    found = components(links).selectExpr("node AS set_id", "component")
    return owners.join(found, "set_id", "left").selectExpr(*kept, "coalesce(component, set_id) AS component")


def listed(rows: DataFrame, key: list[str], place: str) -> DataFrame:
    """``rows`` (key, set_id) with ``before``: the first keys of the set, by ``place``, that stand before the row's own."""
    seen = F.array_sort(F.collect_list(F.struct(F.expr(place).alias("at"), F.xxhash64(*key).alias("code"))))
    seen = rows.groupBy("set_id").agg(F.slice(seen, 1, LISTED).alias("seen"))
    before = F.expr(f"transform(filter(seen, x -> x.at < {place}), x -> x.code)")
    return rows.join(seen, "set_id").withColumn("before", before).drop("seen")


def _folded(lists: list[np.ndarray], size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.stack(lists).view(np.uint64).reshape(len(lists), -1, size), axis=1)


def _codes(before: pa.Array) -> np.ndarray:
    """For each list of ``before`` a bitmap of the values that more than one of them has."""
    _, value, times = np.unique(before.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(before)), before.value_lengths().to_numpy())
    common = times > 1
    value, row = (np.cumsum(common) - 1)[value][common[value]], row[common[value]]
    out = np.zeros((len(before), max(1, -(-int(common.sum()) // 64))), np.uint64)
    np.bitwise_or.at(out, (row, value >> 6), np.uint64(1) << (value & 63).astype(np.uint64))
    return out


def _held(table: pa.Table, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the two rows of each pair of two blocks that may link, part by part."""
    sizes, rest, group, block = (table[x].to_numpy() for x in ("n", "rest", "group_id", "block"))
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    bits = [x.values.to_numpy() for x in table["bits"]]
    codes = _codes(pa.concat_arrays(table["before"].chunks))
    widths = np.array([len(x) for x in bits])
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    for q_width in np.unique(widths[left]):
        for g_width in np.unique(widths[right]):
            i, j = left[widths[left] == q_width], right[widths[right] == g_width]
            size = int(min(q_width, g_width))
            q_all, g_all = _folded([bits[k] for k in i], size), _folded([bits[k] for k in j], size)
            step = max(1, CELLS // (len(j) * size))
            for at in range(0, len(i), step):
                some = i[at : at + step]
                q_n, g_n = sizes[some][:, None], sizes[j][None, :]
                most = np.minimum(rest[some][:, None], rest[j][None, :])
                fit = (100 * q_n >= threshold * g_n) & (100 * g_n >= threshold * q_n)
                fit &= (100 + threshold) * most >= threshold * (q_n + g_n)
                fit &= group[some][:, None] != group[j][None, :]
                if low == high:
                    fit &= some[:, None] < j[None, :]
                x, y = np.nonzero(fit)
                q, g = q_all[at + x], g_all[y]
                x, y = some[x], j[y]
                most = np.minimum(
                    sizes[x] - np.bitwise_count(q & ~g).sum(axis=1, dtype=np.int64),
                    sizes[y] - np.bitwise_count(g & ~q).sum(axis=1, dtype=np.int64),
                )
                keep = (100 + threshold) * most >= threshold * (sizes[x] + sizes[y])
                x, y = x[keep], y[keep]
                part = max(1, CELLS // codes.shape[1])
                for k in range(0, len(x), part):
                    p, q = x[k : k + part], y[k : k + part]
                    new = ~(codes[p] & codes[q]).any(axis=1)  # the others meet at an earlier key
                    yield p[new], q[new]


def _dealt(rows: DataFrame, key: list[str], cost: str, columns: list[str]) -> GroupedData:
    """Any two blocks of a key; ``cost`` sums up to 1 for a block."""
    blocks = rows.groupBy(*key).agg(F.expr(f"CAST(ceil(sum({cost})) AS int)").alias("blocks"))
    cut = rows.join(blocks, key).withColumn("block", F.expr("CAST(pmod(xxhash64(set_id), blocks) AS int)"))
    cut = cut.select("*", F.expr("explode(sequence(0, blocks - 1))").alias("other"))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    return cut.select(*key, low, high, "block", *columns).groupBy(*key, "low", "high")


HELD = ["set_id", "n", "rest", "group_id", "bits", "before"]


def pairs_within(rows: DataFrame, key: list[str], threshold: int) -> DataFrame:
    """(a, b, key): pairs a < b of ``rows`` (key, set_id, n, rest, group_id, bits) of one key that may link.

    The rows of a key are cut by hash into blocks of about ``BLOCK``, and a task holds two blocks against each other,
    by sizes, places and bitmaps. So a row is copied once for each block, not once for each partner. A pair leaves at
    the first key that it shares, as far as :func:`listed` tells, with a null key. Where more than ``CLOSE`` pairs for a row are found in two blocks,
    their sets leave instead, each as ``a`` with its key and a null ``b``, for :func:`links_within`: so never more than so many
    rows for a row leave. Rows of one group are not held against each other; no other pair is left out.
    """
    schema = "a bigint, b bigint, " + ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in key)
    empty = {"int": pa.int32(), "bigint": pa.int64()}
    kinds = [empty[rows.schema[x].dataType.simpleString()] for x in key]
    if "before" not in rows.columns:
        rows = rows.withColumn("before", F.array().cast("array<bigint>"))

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, found, n, close = table["set_id"].to_numpy(), [], 0, CLOSE * table.num_rows
        crowded = np.zeros(table.num_rows, bool)
        for x, y in _held(table, threshold):
            n += len(x)
            crowded[x] = crowded[y] = True
            if n <= close:
                found.append(np.stack([ids[x], ids[y]]))
        if n > close:
            some = table.filter(pa.array(crowded))
            return pa.table([some["set_id"], pa.nulls(len(some), pa.int64()), *(some[x] for x in key)], ["a", "b", *key])
        a, b = np.concatenate([np.empty((2, 0), np.int64), *found], axis=1)
        return pa.table([np.minimum(a, b), np.maximum(a, b), *(pa.nulls(n, x) for x in kinds)], ["a", "b", *key])

    return _dealt(rows, key, f"1 / {BLOCK}", HELD).applyInArrow(work, schema).distinct()


def links_within(rows: DataFrame, key: list[str], threshold: int) -> DataFrame:
    """(a, a_more, b, b_more): links that join all that link of ``rows``, those of :func:`pairs_within` with more, tokens.

    ``tokens`` has all shingles of the set. Blocks are smaller where sets are large. Two sets that are
    joined already are not compared, so two blocks give fewer links than they have rows.
    """

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, more, sizes = (table[x].to_numpy() for x in ("set_id", "more", "n"))
        sets = [x.values.to_numpy() for x in table["tokens"]]
        first: dict[int, int] = {}
        root = [first.setdefault(x, k) for k, x in enumerate(table["group_id"].to_pylist())]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        for some in _held(table, threshold):
            for x, y in zip(*(k.tolist() for k in some)):
                p, q = find(x), find(y)
                if p != q:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                        root[p] = q
                        found.append((x, y))
        x, y = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table([ids[x], more[x], ids[y], more[y]], ["a", "a_more", "b", "b_more"])

    cost = f"1 / {BLOCK} + n / {HELD_SHINGLES}"
    return _dealt(rows, key, cost, [*HELD, "more", "tokens"]).applyInArrow(
        work, "a bigint, a_more bigint, b bigint, b_more bigint"
    )


def close_links(
    rows: DataFrame, close: DataFrame, whole: Callable[[DataFrame], DataFrame], key: list[str], threshold: int
) -> DataFrame:
    """The links of the sets ``close`` (a, key) that :func:`pairs_within` named among ``rows``; written.

    ``whole`` gives (set_id, more, tokens) for a table of set_id.
    """
    named = close.select(F.col("a").alias("set_id"), *key).distinct()
    sets = whole(named.select("set_id").distinct())
    rows = rows.join(named, ["set_id", *key], "left_semi").join(sets.select("set_id", "more", "tokens"), "set_id")
    links = staged(links_within(rows, key, threshold).distinct(), "links")
    dropped(sets)
    return links


def _near(
    rows: DataFrame, facts: DataFrame, whole: Callable[[DataFrame], DataFrame], threshold: int
) -> tuple[DataFrame, DataFrame | None]:
    """The pairs (a, b) of sets in different groups that share a shingle of ``rows`` and may link; written.

    With them, written as well, the links of those among them that are too many to be listed, if any are.
    """
    met = rows.groupBy("token").agg(
        F.count("*").alias("sets"), F.min("group_id").alias("x"), F.max("group_id").alias("y")
    )
    met = met.filter("x < y").select("token", "sets")
    apart = staged(rows.join(met, "token").select("token", "set_id", "n", "rest", "group_id", "sets"), "apart")
    few = apart.filter(f"sets <= {PAIRED}")
    p, q = few.alias("p"), few.alias("q")
    pairs = p.join(q, F.expr(
        f"p.token = q.token AND p.set_id < q.set_id AND p.group_id <> q.group_id AND {_sizes_fit('p.n', 'q.n', threshold)} "
        # no more than the rest of either can be shared from the first shared shingle on
        f"AND {100 + threshold} * least(p.rest, q.rest) >= {threshold} * (p.n + q.n)"
    ))
    pairs = staged(pairs.selectExpr("p.set_id AS a", "q.set_id AS b").distinct(), "pairs")
    known = among(facts, "set_id", pairs.selectExpr("explode(array(a, b)) AS set_id"), "set_id")
    rare = (
        pairs.join(known.selectExpr("set_id AS a", "n AS q_n", "bits AS q_bits"), "a")
        .join(known.selectExpr("set_id AS b", "n AS g_n", "bits AS g_bits"), "b")
        .select("a", "b", "q_n", "q_bits", "g_n", "g_bits")
    )
    many = apart.filter(f"sets > {PAIRED}").drop("sets")
    known = among(facts, "set_id", many, "set_id").select("set_id", "bits")
    many = listed(many, ["token"], "-rest").join(known, "set_id")
    rare = _allowed(rare, threshold, ["a", "b"], "a bigint, b bigint").withColumn("token", F.lit(None).cast("bigint"))
    near = staged(rare.union(pairs_within(many, ["token"], threshold)).distinct(), "near")
    dropped(pairs)
    close = near.filter("b IS NULL")
    links = None if close.isEmpty() else close_links(many, close, whole, ["token"], threshold).select("a", "b")
    dropped(apart)
    return near, links


def joined(groups: DataFrame, links: DataFrame, more: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``groups`` and ``links`` with the written links ``more``, if there are any."""
    if more is None:
        return groups, links
    last, links = links, staged(links.union(more), "links")
    dropped(last, more, groups)
    return groups_of(links), links


def asked(
    near: DataFrame, groups: DataFrame, links: DataFrame, linked: Callable[[DataFrame], DataFrame], few: int = 0
) -> DataFrame:
    """Links that join everything that the pairs ``near`` (a, b) can join; ``links`` are known, ``linked`` verifies.

    First one pair of each two groups is asked, drawn by a hash, then ``DRAWN`` ones, then all pairs that are still
    in different components. So a set next to a large group that it belongs to is not compared with all of it. Up to ``few``
    pairs are asked at once.
    """
    for drawn in (None,) if near.count() <= few else (1, DRAWN, None):
        apart = (
            near.filter("b IS NOT NULL").join(groups.selectExpr("set_id AS a", "group_id AS x"), "a", "left")
            .join(groups.selectExpr("set_id AS b", "group_id AS y"), "b", "left")
            .selectExpr("a", "b", "coalesce(x, a) AS x", "coalesce(y, b) AS y").filter("x <> y")
        )
        if drawn:
            some = [F.min(F.struct(F.xxhash64("a", "b", F.lit(k)), "a", "b")) for k in range(drawn)]
            apart = apart.groupBy(F.least("x", "y"), F.greatest("x", "y")).agg(F.array(*some).alias("some"))
            apart = apart.select(F.inline("some"))
        asking = staged(apart.select("a", "b").distinct(), "asking")
        if asking.isEmpty():
            dropped(asking)
            break
        more = linked(asking)
        last, links = links, staged(links.union(more), "links")
        dropped(asking, last, more)
        if drawn:
            last, groups = groups, groups_of(links)
            dropped(last)
    dropped(near, groups)
    return links


def _whole_sets(texts: DataFrame, words: int) -> DataFrame:
    """(set_id, n, tokens) with every shingle of the ``texts`` (set_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for _, x in T.shingle_sets(T.bytes_of(batch.column(1)), words)]
        sizes = pa.array([len(x) for x in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, lists_of(found)], ["set_id", "n", "tokens"])

    return T.map_batches(texts, work, "set_id bigint, n bigint, tokens array<bigint>")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all columns, but those that reach a smaller id.

    Texts without words and rows without an id stay. An id that repeats goes as a whole if one of its
    rows reaches a smaller id.
    """
    found = similar(docs, doc_id, text, **options).filter("n_shingles > 0 AND doc_id > component_id")
    name = T.fresh(docs, "gone")
    gone = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[doc_id] == gone[name], "left_anti")


def with_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a number for each row, and the name of that column."""
    key = T.fresh(docs, "key")
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def sized_clusters(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    words: int = T.WORDS, threshold: int = 80, frequent: int = FREQUENT,
) -> DataFrame:
    """(doc_id, source, cluster, n_words) for every row of ``docs``: a cluster is alike for linked rows.

    Texts without words are a cluster where they are equal; null and empty ones have none.
    """
    docs = docs.select(T.ids(doc_id).cast("bigint"), T.ids(text, "text"), T.ids(source, "source").cast("string"))
    rows = _components(docs, ["doc_id", "source", "n", "n_words", "digest"], words, threshold, frequent)
    cluster = "CASE WHEN n > 0 THEN component WHEN digest NOT IN (xxhash64(CAST(NULL AS string)), xxhash64('')) THEN digest END"
    return rows.selectExpr("doc_id", "source", f"{cluster} AS cluster", "n_words")


def one_row_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all columns, but of each group of linked rows only one.

    The row with the least id stays, a null one last, and of rows that share it any one. What becomes of
    a row hangs on its own text, whatever other rows have its id. Texts without words stay.
    """
    keyed, key = with_keys(docs)
    ids = keyed.select(F.col(key).alias("row"), T.ids(doc_id, "id"))
    found = similar(keyed, key, text, **options).filter("n_shingles > 0").selectExpr("doc_id AS row", "component_id")
    rows = staged(found.join(ids, "row"), "rows")
    first = rows.groupBy("component_id").agg(
        F.count("*").alias("times"), F.min(F.struct(F.isnull("id"), "id", "row")).alias("first")
    )
    gone = rows.join(first.filter("times > 1"), "component_id").filter("row <> first.row")
    name = T.fresh(keyed, "gone")
    gone = gone.select(F.col("row").alias(name))
    return keyed.join(gone, keyed[key] == gone[name], "left_anti").drop(key)
