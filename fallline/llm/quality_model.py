"""Quality classifier: a factorisation machine over hashed words, structure and length.

A text's features are its distinct words, hashed, with weights of unit length together; shares such
as upper case, symbols and repeated lines, each as one of a few steps; and the sizes of the text. Every
pair of features interacts through low-rank vectors, and the sum over all pairs takes linear time:
half of (sum of v x) squared less sum of (v x) squared, for each of ``RANK`` dimensions.

The model is fitted on the driver on at most ``SAMPLE`` labelled rows, those of the least
hash of their id, so they do not depend on the order of the rows; what is collected for it
is their features alone. Ids with ``crc32(id) mod 3 = 1`` are held out and never learned from.
Language, source and id are no features. All rows are then scored in the tasks that read them, by
whole texts and without a shuffle.

Null and empty texts have the features of an empty text and get a score as well. A null id
is not held out and not learned from. Of repeated ids in the labels the larger label counts; of
repeated documents one is learned from and each is scored. With no labels every score is 0.5; with one
class alone, near its label.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

HASHED = 1 << 15
RANK, EPOCHS, RATE, DECAY, BATCH = 8, 10, 0.05, 1e-4, 64
SAMPLE = 4000
STEPS = 16
_SHARES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>", b"0123456789", b"|", b"!?", b".,;:", b"\n", b" ",
)
STRUCTURE = len(_SHARES) + 7
SIZE = HASHED + STRUCTURE * STEPS


def _structure(data: bytes, words: np.ndarray, distinct: int) -> list[int]:
    """A step from 0 to STEPS - 1 for each share and size."""
    n = max(1, len(data))
    shares = [(len(data) - len(data.translate(None, x))) / n for x in _SHARES]
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = T.windows(words)
    shares.append(1 - len(set(lines)) / max(1, len(lines)))
    shares.append(1 - len(np.unique(windows)) / max(1, len(windows)))
    shares.append(distinct / max(1, len(words)))
    steps = [min(STEPS - 1, int(np.sqrt(x) * STEPS)) for x in shares]
    sizes = (len(words), len(lines), len(data) / max(1, len(words)), len(words) / max(1, len(lines)))
    return steps + [min(STEPS - 1, int(np.log2(1 + x))) for x in sizes]


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position, feature numbers and values of each text."""
    for at, words in T.texts_words([x.lower() for x in texts]):
        own = np.unique(words & np.uint64(HASHED - 1)).astype(np.int64)
        steps = _structure(texts[at], words, len(own))
        more = HASHED + np.arange(STRUCTURE) * STEPS + np.array(steps)
        values = np.concatenate([np.full(len(own), 1 / np.sqrt(max(1, len(own)))), np.full(STRUCTURE, 0.5)])
        yield at, np.concatenate([own, more]), values


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        """The sum over all pairs by the square of the sum."""
        vx = self.vectors[at] * x[:, None]
        pairs = 0.5 * (np.square(vx.sum(axis=0)) - np.square(vx).sum(axis=0)).sum()
        return float(self.bias + self.weight[at] @ x + pairs)

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, x), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine fitted by steps scaled by past gradients; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    if not len(rows):
        return Machine(0.0, np.zeros(SIZE), np.zeros((SIZE, RANK)))
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    past_w, past_v = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for begin in range(0, len(rows), BATCH):
            chosen = order[begin : begin + BATCH]
            at = np.concatenate([rows[k][0] for k in chosen])
            x = np.concatenate([rows[k][1] for k in chosen])
            sizes = np.array([len(rows[k][0]) for k in chosen])
            first = np.cumsum(sizes) - sizes
            vx = model.vectors[at] * x[:, None]
            sums = np.add.reduceat(vx, first)
            raw = model.bias + np.add.reduceat(model.weight[at] * x, first)
            raw += 0.5 * (np.square(sums) - np.add.reduceat(np.square(vx), first)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(error, sizes) * x
            grad_v = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            by = np.argsort(at, kind="stable")
            own, start = np.unique(at[by], return_index=True)
            gw = np.add.reduceat(each[by], start) + DECAY * model.weight[own]
            gv = np.add.reduceat(grad_v[by], start) + DECAY * model.vectors[own]
            past_w[own] += np.square(gw)
            past_v[own] += np.square(gv)
            model.weight[own] -= RATE * gw / np.sqrt(past_w[own])
            model.vectors[own] -= RATE * gv / np.sqrt(past_v[own])
            model.bias -= RATE * float(error.sum())
    return model


def held_out(doc_id: Column) -> Column:
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """``docs`` (doc_id, text), ``labels`` (doc_id, label 0 or 1)."""
    known = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(k.astype(np.int32).tobytes(), x.astype(np.float32).tobytes())
                 for _, k, x in features(T.bytes_of(batch.column(1)))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *(pa.array(x, pa.binary()) for x in zip(*found))],
            ["doc_id", "label", "at", "x"],
        )

    met = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("label").cast("double"))
    rows = T.map_batches(met, work, "doc_id bigint, label double, at binary, x binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("at", "x", "label")).alias("r"))
    found = sorted((r.doc_id, bytes(r.r.at), bytes(r.r.x), r.r.label) for r in rows.collect())
    pairs = [(np.frombuffer(k, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64))
             for _, k, x, _ in found]
    return fit(pairs, np.array([y for *_, y in found]))


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def score(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    label_id: str = "doc_id",
    sample: int = SAMPLE,
) -> DataFrame:
    """Score and verdict of every row of ``docs``."""
    docs = docs.select(T.ids(doc_id).cast("bigint"), T.ids(text, "text"))
    labels = labels.select(T.ids(label_id).cast("bigint"), T.ids(label, "label"))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.zeros(batch.num_rows)
        for at, k, x in features(T.bytes_of(batch.column(2))):
            scores[at] = model.value.score(k, x)
        predicted = pa.array((scores >= 0.5).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(scores), predicted],
            ["doc_id", "held_out", "score", "predicted"],
        )

    picked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return T.map_batches(picked, work, SCHEMA)
