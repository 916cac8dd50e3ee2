"""Exact dedup of whole texts: owners in Patricia tries.

Texts are equal when they are the same bytes after each run of white space has become one space.

1. A first pass makes (length, content hash) of every text; keys that occur once own their text. Nothing but
   keys is shuffled.
2. In a second pass each task inserts the texts whose key repeats into a compressed radix trie. A terminal node
   stores the smallest identifier and the number of its rows, so a task hands on each text once,
   however many copies it has read.
3. The terminals are dealt to partitions by length and content hash and their full byte strings inserted again;
   equal strings meet in one terminal, different ones of one key do not. A key with more than ``FAN_IN``
   terminals is first dealt over several partitions, and their terminals meet in a further round, so no task
   gets a group of any size at once. A trie that outgrows its memory gives up its heaviest subtree,
   whose texts go on in a further round over more partitions.
4. Each row takes the owner of its terminal.

Every round is written to the shared folder. Null counts as the empty text, which is a text like others. Of
equal texts the row with the smallest id stays, null last, and of rows that share it exactly one. Very long
texts are held whole, one at a time besides the trie. Extra columns are ignored.
"""

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import staged
from .ngram_join import filter_of, passes

#: Terminals of one key that meet in one task at most.
FAN_IN = 1024
#: Bytes of text that a trie holds before it gives up a subtree.
MEMORY = 64 << 20
#: Keys with more terminals than that are sent to all tasks if they are at most so many.
MOST_BROADCAST = 100_000


def normal(data: bytes) -> bytes:
    """``data`` with each run of white space as one space."""
    words = data.split()
    if not words:
        return b" " if data else b""
    first = b" " if data[:1].isspace() else b""
    return first + b" ".join(words) + (b" " if data[-1:].isspace() else b"")


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie of byte strings, with a value at the terminal node of each."""

    def __init__(self):
        #: A node is [label, children by first byte, value]; the root has no label.
        self.root = [b"", {}, None]
        self.held: dict[int | None, int] = {}  # bytes below each branch of the root

    def find(self, data: bytes) -> list:
        """The terminal node of ``data``, which is made if there is none."""
        node, at = self.root, 0
        while at < len(data):
            child = node[1].get(data[at])
            if child is None:
                child = node[1][data[at]] = [data[at:], {}, None]
                branch = data[0]
                self.held[branch] = self.held.get(branch, 0) + len(child[0])
                return child
            k = len(child[0])
            if not data.startswith(child[0], at):
                k = _common(child[0], data, at)
                upper = [child[0][:k], {child[0][k]: child}, None]
                child[0] = child[0][k:]
                child = node[1][data[at]] = upper
            node, at = child, at + k
        return node

    def size(self) -> int:
        return sum(self.held.values())

    def heaviest(self) -> int:
        return max(self.held, key=self.held.get)

    def terminals(self, branch: int | None = None) -> Iterator[tuple[bytes, list]]:
        """Each string with a value, and the value; of one branch of the root, or all."""
        nodes = [(b"", self.root)] if branch is None else [(b"", self.root[1][branch])]
        while nodes:
            prefix, node = nodes.pop()
            prefix += node[0]
            if node[2] is not None:
                yield prefix, node[2]
            nodes.extend((prefix, child) for child in node[1].values())

    def give_up(self, branch: int) -> None:
        del self.root[1][branch], self.held[branch]


#: A link has item and node; a terminal has node, key, owner, size, text, and whether a further round is needed.
SCHEMA = (
    "doc_id bigint, digest binary, item bigint, node bigint, length bigint, hash bigint, "
    "owner bigint, owner_row bigint, size bigint, text binary, open boolean"
)
_ARROW = pa.schema(
    [(n, {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t])
     for n, t in (x.split() for x in SCHEMA.split(", "))]
)


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _smaller(a: tuple, b: tuple) -> tuple:
    """The smaller of two owners (id, row); a null id is the largest."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


class _Owners:
    """The trie of one task and the rows that it gives."""

    def __init__(self, memory: int):
        self.memory = memory
        self.trie, self.keys, self.gone, self.rows = Trie(), set(), set(), []

    def link(self, item: int, node: int | None, doc_id: int | None = None, digest: bytes | None = None) -> None:
        self.rows.append((doc_id, digest, item, node, None, None, None, None, None, None, None))

    def give(self, text: bytes, value: list, spilled: bool) -> None:
        node, length, digest, owner, size, often = value
        self.rows.append((None, None, None, node, length, digest, *owner, size, text, spilled or often))

    def put(self, text: bytes, item: int, owner: tuple, size: int, key: tuple[int, int], often: bool) -> int:
        """The node that ``item`` belongs to."""
        if text[:1] and text[0] in self.gone:  # its subtree goes on in a further round
            self.give(text, [item, *key, owner, size, often], True)
            return item
        at = self.trie.find(text)
        if at[2] is None:
            at[2] = [item, *key, owner, size, often]
            self.keys.add(key)
            self.spill()
        else:
            at[2][3] = _smaller(at[2][3], owner)
            at[2][4] += size
        return at[2][0]

    def spill(self) -> None:
        while self.trie.size() > self.memory and len(self.keys) > 1 and self.trie.held:
            branch = self.trie.heaviest()
            for text, value in self.trie.terminals(branch):
                self.give(text, value, True)
                self.keys.discard(tuple(value[1:3]))
            self.trie.give_up(branch)
            self.gone.add(branch)

    def finish(self) -> None:
        for text, value in self.trie.terminals():
            self.give(text, value, False)
        self.trie, self.keys, self.gone = Trie(), set(), set()

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What has been given, in batches of a bounded size."""
        begin = held = 0
        for k, row in enumerate(self.rows):
            held += len(row[9] or b"") + 64
            if held > T.BATCH_BYTES or k + 1 == len(self.rows):
                columns = [pa.array(x, f.type) for x, f in zip(zip(*self.rows[begin : k + 1]), _ARROW)]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)
                begin, held = k + 1, 0
        self.rows = []


def _keys(docs: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normal(x) for x in T.bytes_of(batch.column(0))]
        columns = [pa.array([len(x) for x in texts], pa.int64()), pa.array([_hash(x) for x in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["length", "hash"])

    return T.map_batches(docs.select("text"), work, "length bigint, hash bigint")


def _combined(docs: DataFrame, repeated: DataFrame, memory: int) -> DataFrame:
    """A link for every row, with a node where its key may repeat, and the terminals of every task."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(repeated, "hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, owners = TaskContext.get().partitionId() << 33, _Owners(memory)
        for batch in batches:
            texts = [normal(x) for x in T.bytes_of(batch.column(1))]
            hashes = pa.array([_hash(x) for x in texts], pa.int64())
            often = passes(bits.value, hashes.to_numpy())
            numbers = batch.column(2).to_pylist() if batch.num_columns > 2 else range(row, row + batch.num_rows)
            row += batch.num_rows
            values = zip(batch.column(0).to_pylist(), texts, hashes.to_pylist(), often, numbers)
            for doc_id, text, key, may, number in values:
                node = owners.put(text, number, (doc_id, number), 1, (len(text), key), False) if may else None
                owners.link(number, node, doc_id, sha256(text).digest())
                if owners.gone:  # within a task copies are only joined as far as memory goes
                    owners.finish()
            yield from owners.batches()
        owners.finish()
        yield from owners.batches()

    T.batched(docs.sparkSession)
    return docs.mapInArrow(run, SCHEMA)


def _round(nodes: DataFrame, parts: int, fan_in: int, memory: int) -> DataFrame:
    """Terminals of terminals: a link for each of ``nodes``, and the nodes that they meet in."""
    often = staged(nodes.groupBy("length", "hash").count().filter(f"count > {fan_in}"), "often")
    n = often.count()
    if n:
        often = F.broadcast(often) if n <= MOST_BROADCAST else often
        nodes = nodes.join(often, ["length", "hash"], "left")
    salts = F.expr(f"CAST(coalesce(ceil(count / {fan_in}), 1) AS bigint)") if n else F.lit(1).cast("bigint")
    items = nodes.select(
        "node", "length", "hash", "owner", "owner_row", "size", "text", (salts > 1).alias("often"),
        F.pmod(F.xxhash64("node"), salts).alias("salt"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = _Owners(memory)
        for batch in batches:
            for item, length, key, owner, row, size, text, often, _ in zip(*(c.to_pylist() for c in batch.columns)):
                owners.link(item, owners.put(text, item, (owner, row), size, (length, key), often))
            yield from owners.batches()
        owners.finish()
        yield from owners.batches()

    return items.repartition(parts, "length", "hash", "salt").mapInArrow(run, SCHEMA)


def owners(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    fan_in: int = FAN_IN,
    memory: int = MEMORY,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    docs = docs.select(T.ids(doc_id).cast("bigint"), T.ids(text, "text").cast("string"))
    return _decided(docs, fan_in, memory).drop("item")


def _decided(docs: DataFrame, fan_in: int = FAN_IN, memory: int = MEMORY) -> DataFrame:
    """The same, and ``item``, the number of the row: that in column ``row`` if ``docs`` has one."""
    spark = docs.sparkSession
    repeated = staged(_keys(docs).groupBy("length", "hash").count().filter("count > 1").select("hash"), "repeated")
    rows = staged(_combined(docs, repeated, memory), "combined")
    members = rows.filter("item IS NOT NULL").select("doc_id", "digest", "item", "node")

    # rounds over the terminals, until none is open
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes, found, ways = rows.filter("size IS NOT NULL"), [], None
    while True:
        held = nodes.agg(F.sum("length")).first()[0] or 0
        parts = max(parts, -(-2 * held // memory))
        rows = staged(_round(nodes, parts, fan_in, memory), "round")
        links = rows.filter("item IS NOT NULL").select("item", F.col("node").alias("next"))
        if ways is None:
            ways = links.selectExpr("item AS node", "next")
        else:
            further = links.withColumnRenamed("next", "last")
            ways = ways.join(further, ways["next"] == further["item"], "left")
            ways = ways.select("node", F.coalesce("last", "next").alias("next"))
        met = rows.filter("size IS NOT NULL")
        found.append(met.filter("NOT open").select(F.col("node").alias("next"), "owner", "owner_row", "size"))
        nodes = met.filter("open")
        if nodes.isEmpty():
            break
        parts *= 2
    ends = found[0]
    for more in found[1:]:
        ends = ends.union(more)
    owned = ways.join(ends, "next").select("node", "owner", "owner_row", "size")
    alone = members.filter("node IS NULL").selectExpr("doc_id", "doc_id AS owner", "item AS owner_row", "1L AS size", "digest", "item")
    among = members.filter("node IS NOT NULL").join(owned, "node").select(alone.columns)
    return alone.union(among).select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("owner_row") == F.col("item")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "item",
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all columns, but of equal texts only the one that stays."""
    key = T.fresh(docs, "key")
    keyed = staged(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    name = T.fresh(keyed, "gone")
    found = _decided(keyed.select(T.ids(doc_id).cast("bigint"), T.ids(text, "text").cast("string"), T.ids(key, "row")), **options)
    gone = found.filter("NOT kept").select(F.col("item").alias(name))
    return keyed.join(gone, keyed[key] == gone[name], "left_anti").drop(key)
