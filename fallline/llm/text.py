"""Words and shingles of whole texts, worked out with numpy on Arrow batches.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage
return; in UTF-8 these bytes occur in no other character. A word stands for itself as a 64-bit hash,
so two different words are taken as equal with a chance of about 2**-64.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
#: Bytes of text worked on at once; bounds the memory of a task whatever the texts' lengths.
BLOCK = 1 << 20
BATCH_BYTES = 4 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(np.asarray(x, dtype=np.uint64))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return _mixed(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = seeds(256, 1000)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WINDOW = seeds(WORDS, 5000) | np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def _block_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words in ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edges = np.diff(np.concatenate([[True], _IS_SPACE[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = _tables(len(raw))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
        return _mixed((total[ends] - total[starts]) * down[starts]), starts


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of one text, in order."""
    if len(data) <= BLOCK:
        return _block_words(data)[0]
    out, begin = [], 0
    while begin < len(data):
        end = min(len(data), begin + BLOCK)
        while end < len(data) and not _IS_SPACE[data[end]]:  # no word is cut
            end += 1
        out.append(_block_words(data[begin:end])[0])
        begin = end
    return np.concatenate(out)


def texts_words(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Position and word hashes of each text; short texts are worked out together."""
    group: list[bytes] = []
    first = held = 0
    for at, data in enumerate(texts):
        if held + len(data) > BLOCK and group:
            yield from _group_words(first, group)
            group, held = [], 0
        if len(data) > BLOCK:
            yield at, word_hashes(data)
            continue
        if not group:
            first = at
        group.append(data)
        held += len(data) + 1
    if group:
        yield from _group_words(first, group)


def _group_words(first: int, group: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    hashes, starts = _block_words(b" ".join(group))
    ends = np.cumsum([len(x) + 1 for x in group])
    cuts = np.searchsorted(starts, ends)
    begin = 0
    for k, cut in enumerate(cuts):
        yield first + k, hashes[begin:cut]
        begin = cut


def windows(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """A hash for each run of ``n`` words; with fewer words, one for the whole sequence."""
    with np.errstate(over="ignore"):
        if len(words) < n:
            n = len(words)
            if not n:
                return np.empty(0, np.uint64)
        more = _WINDOW if n <= WORDS else seeds(n, 5000) | np.uint64(1)
        total = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
        for k in range(n):
            total += words[k : len(words) - n + 1 + k] * more[k]
        return _mixed(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different ``values`` in order; of short arrays, in a fraction of the time of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(texts: list[bytes], n: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Position and sorted distinct shingles of each text, ``A-Z`` taken as ``a-z``."""
    for at, words in texts_words([x.lower() for x in texts]):
        yield at, distinct(windows(words, n))


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 texts of a column; null gives an empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batched(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of this session by bytes, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``work`` on each batch of rows, within the tasks that read them."""
    batched(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows of ``df``, every column as it was, whose text ``keep`` wants."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(batch.column(text))))

    return map_batches(df, work, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def ids(column: str, name: str = "doc_id") -> Column:
    return F.col(f"`{column}`").alias(name)
