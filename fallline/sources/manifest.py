"""The list of downloaded source files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fallline.schema import MANIFEST

_MIB = 1024.0 * 1024.0


def read_manifest(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Download records from a JSON array, or from one record per line."""
    options = {"multiLine": not one_per_line, "mode": "FAILFAST"}
    return spark.read.schema(MANIFEST).options(**options).json(path)


def write_manifest(records: DataFrame, path: str) -> None:
    """Write records one per line, in parallel."""
    records.write.mode("overwrite").json(path)


def record_manifest(
    rows: DataFrame,
    url: Column,
    relative_path: Column,
    content: Column,
    last_modified: Column,
    downloaded: Column,
) -> DataFrame:
    """A manifest record for each row of a table that holds downloaded content, text or bytes.

    The content is stored as it came, so its sizes are the same. No shuffle.
    """
    size = F.octet_length(content) / _MIB
    return rows.select(
        url.alias("url"),
        relative_path.alias("relative_path"),
        last_modified.alias("last_modified"),
        downloaded.alias("downloaded"),
        size.alias("content_size_mb"),
        size.alias("compressed_size_mb"),
        F.sha2(content.cast("binary"), 256).alias("checksum_sha256"),
    )


#: Suffixes of the compressed files that Spark's text reader unpacks.
_COMPRESSED = r"\.(gz|bz2|deflate|zst|snappy|lz4)$"


def file_manifest(
    spark: SparkSession,
    path: str | list[str],
    pattern: str = "*",
    root: str = "",
    url_root: str | None = None,
    downloaded: str | None = None,
) -> DataFrame:
    """The manifest record of each file, one row per file; paths are relative to ``root``.

    ``url_root`` is where the files came from and ``downloaded`` when. A file is one value here, as a
    checksum needs all its bytes in order, so files must stay below 2 GB (Spark fails beyond); many
    files spread over tasks. Only compressed files are read again to measure their content.
    """
    paths = [path] if isinstance(path, str) else list(path)
    prefix = root.rstrip("/") + "/" if root else ""

    def relative(column: str) -> Column:
        plain = F.regexp_replace(column, "^file:/+", "/")
        inside = F.substring(plain, len(prefix) + 1, 100_000)
        return F.when(F.startswith(plain, F.lit(prefix)), inside).otherwise(plain)

    stored = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(paths)
        .select(
            relative("path").alias("relative_path"),
            F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_modified"),
            (F.col("length") / _MIB).alias("compressed_size_mb"),
            F.sha2("content", 256).alias("checksum_sha256"),
        )
    )
    unpacked = (
        spark.read.option("pathGlobFilter", pattern)
        .text(paths, wholetext=True)
        .filter(F.col("_metadata.file_path").rlike(_COMPRESSED))
        .select(
            relative("_metadata.file_path").alias("relative_path"),
            (F.octet_length("value") / _MIB).alias("_unpacked"),
        )
    )
    url = F.concat(F.lit(url_root.rstrip("/") + "/"), "relative_path") if url_root else F.lit(None)
    return stored.join(unpacked, "relative_path", "left").select(
        url.cast("string").alias("url"),
        "relative_path",
        "last_modified",
        F.lit(downloaded).cast("string").alias("downloaded"),
        F.coalesce("_unpacked", "compressed_size_mb").alias("content_size_mb"),
        "compressed_size_mb",
        "checksum_sha256",
    )
