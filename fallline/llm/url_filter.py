"""URL filters: rules and a block list in one sorted array of 64-bit digests.

An entry is a host and the start of a path. It fits a URL of its host or a subdomain whose path
begins with the entry's path. The entries' xxhash64 digests lie sorted in a file, beside them the full
strings; the file goes to every executor and is mapped into memory there, so workers of one machine
share it. A URL's candidates are the ends of its host joined with the starts of its path, at the path
lengths that entries have; they are looked up together by binary search, and a hit counts only if the
stored string is the candidate's, so digests that collide do no harm.

The longest rule decides. Where no rule fits, a URL is blocked if a block-list entry fits, else allowed.
A null URL or one without ``://`` has an empty host and path and is allowed. One row gives one row,
nothing is shuffled; repeated rows are judged alike.
"""

import os
import tempfile
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from . import text as T

#: (host, start of path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: An example, with the bad hosts of the test pages; a real list comes as a file or a table.
BLOCKED = tuple(
    (f"{name}.example.{top}", "")
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)
_ALLOW, _BLOCK, _LISTED = 0, 1, 2
_UPPER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z in lower case, and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_UPPER), path


def write_array(entries: Iterable[tuple[str, int]], path: str) -> None:
    """The file: count, longest host in labels, path lengths, then digests, offsets, kinds, strings."""
    rows = sorted({(xxhash.xxh64_intdigest(s.encode()), s.encode(), kind) for s, kind in entries})
    hosts = [s.split(b"/", 1) for _, s, _ in rows]
    lengths = sorted({len(s.decode()) - len(h[0].decode()) for (_, s, _), h in zip(rows, hosts)})
    labels = max((h[0].count(b".") + 1 for h in hosts), default=0)
    ends = np.cumsum([0] + [len(s) for _, s, _ in rows], dtype=np.uint64)
    with open(path, "wb") as file:
        np.array([len(rows), labels, len(lengths), *lengths], dtype=np.uint64).tofile(file)
        np.array([d for d, _, _ in rows], dtype=np.uint64).tofile(file)
        ends.tofile(file)
        np.array([k for *_, k in rows], dtype=np.uint64).tofile(file)
        file.write(b"".join(s for _, s, _ in rows))


class Digests:
    """The mapped file."""

    def __init__(self, path: str):
        head = np.memmap(path, dtype=np.uint64, mode="r", shape=(os.path.getsize(path) // 8,))
        n, self.labels, k = (int(x) for x in head[:3])
        self.lengths = [int(x) for x in head[3 : 3 + k]]
        at = 3 + k
        self.digests, self.ends = head[at : at + n], head[at + n : at + 2 * n + 1]
        self.kinds = head[at + 2 * n + 1 : at + 3 * n + 1]
        self.strings = np.memmap(path, dtype=np.uint8, mode="r", offset=8 * (at + 3 * n + 1)) if n else None

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """For each candidate the bits of the kinds of entries that it equals."""
        out = np.zeros(len(candidates), dtype=np.int64)
        keys = np.array([xxhash.xxh64_intdigest(x) for x in candidates], dtype=np.uint64)
        left = np.searchsorted(self.digests, keys, side="left")
        right = np.searchsorted(self.digests, keys, side="right")
        for k in np.flatnonzero(left < right):
            for at in range(left[k], right[k]):
                stored = self.strings[int(self.ends[at]) : int(self.ends[at + 1])].tobytes()
                if stored == candidates[k]:
                    out[k] |= 1 << int(self.kinds[at])
        return out


@lru_cache(maxsize=4)
def _mapped(name: str) -> Digests:
    return Digests(SparkFiles.get(name))


def judge_urls(digests: Digests, parts: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
    """Rule and verdict of each (host, path)."""
    candidates, owner = [], []
    for row, (host, path) in enumerate(parts):
        if not host:
            continue
        labels = host.split(".")
        tails = [".".join(labels[-k:]) for k in range(1, min(len(labels), digests.labels) + 1)]
        for size in digests.lengths:
            if size <= len(path):
                candidates += [(tail + path[:size]).encode() for tail in tails]
                owner += [row] * len(tails)
    rules: dict[int, tuple[int, str, str]] = {}
    listed = set()
    for k in np.flatnonzero(found := digests.find(candidates)):
        row, text = owner[k], candidates[k].decode()
        if found[k] >> _LISTED & 1:
            listed.add(row)
        if found[k] & 3:
            verdict = "block" if found[k] >> _BLOCK & 1 else "allow"
            rules[row] = max(rules.get(row, (0, "", "")), (len(text), text, verdict))
    out = []
    for row in range(len(parts)):
        if row in rules:
            out.append(rules[row][1:])
        else:
            out.append((None, "block" if row in listed else "allow"))
    return out


def read_list(blocked: str | DataFrame | Iterable[tuple[str, str]]) -> Iterable[tuple[str, str]]:
    """(host, start of path) of the entries, from pairs, a table (host[, path]) or a text file.

    A file has an entry in each line, host and path without a space between; empty lines and those that begin
    with ``#`` are none. The driver holds the list once; A-Z of a host count as a-z.
    """
    if isinstance(blocked, str):
        with open(blocked, encoding="utf-8") as file:
            lines = [x.strip() for x in file]
        pairs = (x.partition("/") for x in lines if x and not x.startswith("#"))
        blocked = ((host, slash + path) for host, slash, path in pairs)
    elif isinstance(blocked, DataFrame):
        path = "path" if "path" in blocked.columns else "CAST(NULL AS string) AS path"
        rows = blocked.selectExpr("host", path).filter("host <> ''").distinct().toLocalIterator()
        blocked = ((r.host, r.path or "") for r in rows)
    return ((host.translate(_UPPER), path) for host, path in blocked)


SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    blocked: str | DataFrame | Iterable[tuple[str, str]] = BLOCKED,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Host, path, rule and verdict of every row. Of equal rules a blocking one counts.

    ``blocked`` is the block list, of any size that the driver holds: see :func:`read_list`.
    """
    context = pages.sparkSession.sparkContext
    name = f"digests-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="digests-"), name)
    entries = [(h + p, _BLOCK if v == "block" else _ALLOW) for h, p, v in rules]
    write_array([*entries, *((h + p, _LISTED) for h, p in read_list(blocked))], path)
    context.addFile(path)  # Spark hands the driver's file to the executors

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [split_url(x) for x in batch.column(1).to_pylist()]
        hosts, paths = zip(*parts)
        rule, verdict = zip(*judge_urls(_mapped(name), parts))
        columns = [pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *columns], ["page_id", "host", "path", "rule", "verdict"]
        )

    return T.map_batches(pages.select(T.ids(page_id, "page_id"), T.ids(url, "url")), work, SCHEMA)
