"""Stages in the shared folder, and connected components of a table of links."""

from collections.abc import Iterator
from itertools import chain
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallline.session import new_table_path

#: Where the stages of this session lie, as long as somebody holds them.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
ROW_GROUP = 16 << 20
#: Links that a task joins at once.
HELD_LINKS = 1 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again."""
    path = new_table_path(df.sparkSession, name)
    # small row groups: a task that writes several wide columns holds one row group of each at a time
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    stage = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[stage] = path
    return stage


def dropped(*stages: DataFrame) -> None:
    """Delete written stages whose last reader has been written itself; nothing may read them any more."""
    for stage in stages:
        path = _PATHS.pop(stage, None)
        if path:
            jvm, context = stage.sparkSession._jvm, stage.sparkSession.sparkContext
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links ``a``, ``b`` but the least of its component among them, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (jumped := root[root])).any():
            root = jumped
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the least node reachable."""
    found = stars(links)
    return found.selectExpr("a AS node", "b AS component").union(
        found.selectExpr("b AS node", "b AS component").distinct()
    )


def stars(links: DataFrame) -> DataFrame:
    """(a, b) for every node ``a`` of ``links`` but the least of its component, which is ``b``; written.

    In a round, the links of a task, up to ``HELD_LINKS`` at once, are joined to stars: each node links to the least of its part.
    Of the stars that a node is in, it keeps the least centre, and the other centres link to that one. A centre that is a
    node of another star hands its own nodes on to that star's centre. Rounds end when no node is in two stars and no centre is a
    node. A node comes from a task only once for as many links, so no step brings a component together in one task.
    """
    most = HELD_LINKS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if held and (batch is None or sum(map(len, held)) + len(batch) > most):
                a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(a, b)], ["a", "b"])
                held = []
            if batch is not None:
                held.append(batch)

    links = staged(links.filter("a <> b").select("a", "b"), "links")
    while True:
        held = links.select("a", "b").mapInArrow(work, "a bigint, b bigint")
        held = held.groupBy("a").agg(F.collect_set("b").alias("centres")).withColumn("m", F.array_min("centres"))
        on = F.expr("explode(array_union(array(a), array_remove(centres, m))) AS a")
        both = held.select(on, "m", F.expr("size(centres) > 1 AS moved")).withColumnRenamed("m", "b")
        found = both.join(held.selectExpr("a AS b", "m"), "b", "left")
        found = found.selectExpr("a", "coalesce(m, b) AS b", "moved OR m IS NOT NULL AS moved")
        last, links = links, staged(found, "links")
        dropped(last)
        if links.filter("moved").isEmpty():
            break
    return links.select("a", "b")
