"""What the operators of this subpackage share: scratch tables, words, checksums, small frames."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of bytes other than these six; `bytes.split()` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset and all runs on one machine, as in tests, a temporary folder is made and set; elsewhere
    it is an error, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="mnemora-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of df: writes it as Parquet into the shared folder and reads it back.

    As zstd, since the buffers of snappy lie outside the heap and grow with the largest cells.
    """
    path = f"{scratch_dir(df.sparkSession)}/mnemora/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what a worker has freed to the system: workers live on, and would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def with_own(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns; columns of df with the same names (in any case) give way."""
    mine = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine], *[v.alias(k) for k, v in columns.items()])


def sheltered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1, ..., so that none clashes with a helper's, and what names became."""
    new = [f"c{i}" for i in range(len(df.columns))]
    lower = [c.lower() for c in df.columns]
    return df.toDF(*new), [new[lower.index(n.lower())] for n in names]


def restored(df: DataFrame, columns: list[str], own: dict[str, Column]) -> DataFrame:
    """A sheltered frame under its old names, with these columns; old ones of the same names give way."""
    mine = {c.lower() for c in own}
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in mine]
    return df.select(*kept, *[v.alias(k) for k, v in own.items()])


def utf8_bytes(text: Column) -> Column:
    """The number of UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned CRC-32 of the decimal id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
