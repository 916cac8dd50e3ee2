import pytest
from pyspark.sql import types as T

#: Names that the operators use themselves, as columns that come along and must do no harm.
CLASHES = ("digest", "set_id", "n", "token", "shard", "size", "at", "gone", "label", "marks", "class", "row")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, partitions=3):
        """Rows of (doc_id, text[, lang, source]) with further columns of clashing names."""
        fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType())]
        schema = T.StructType(
            [T.StructField(n, t) for n, t in fields] + [T.StructField(n, T.StringType()) for n in CLASHES]
        )
        full = [(*r, *[None] * (4 - len(r)), *CLASHES) for r in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls in any column, empty and white texts, a very long one, ties and repeated rows."""
    words = " ".join(f"w{k}" for k in range(200))
    return [
        (1, words, "en", "a"),
        (1, words, "en", "a"),
        (2, words.upper(), None, None),
        (3, None, "en", "a"),
        (None, words, None, "b"),
        (None, None, None, None),
        (4, "", "xx", "a"),
        (5, " \t\n\x0b\f\r ", "de", "b"),
        (6, "one", "fr", "c"),
        (7, "é" * 3000 + " " + "x" * 3000, "en", "a"),
        (8, "lorem ipsum dolor " * 70000, "en", "a"),
    ]
