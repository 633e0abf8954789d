"""Shared pieces: cuts of lineage, byte-level words, row identity, samples.

Conventions held by every operator of this subpackage:

* input columns may be null, input tables may be empty, rows may repeat, and
  extra columns may have any name: operators select the columns they need at
  the start and use their own names from there on; where whole rows come back,
  their other columns travel as one struct with fields named by place;
* text is processed whole, as UTF-8 bytes or by JVM functions;
* intermediate results are cut by writing Parquet in the shared folder that
  the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_cut_number = itertools.count()

#: Most rows in one Arrow batch handed to a Python worker; texts may be long.
BATCH_ROWS = 512


def _byte_table(keep_word) -> bytes:
    """A ``bytes.translate`` table: A-Z to lower case, non-word bytes to a space."""
    return bytes(
        (b + 32 if 65 <= b <= 90 else b) if keep_word(b) else 32 for b in range(256)
    )


#: Lower-cases A-Z only; white space is left to ``bytes.split``, which takes
#: exactly space and 0x09-0x0D as separators.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: For the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a lower-cased text:
#: digits, letters a-z and every byte of a non-ASCII character belong to words.
LOWER_WORDS = _byte_table(lambda b: b >= 128 or chr(b).isalnum())


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A-Z lower-cased; null has none."""
    return text.translate(LOWER_WORDS).split() if text else []


def column(name: str) -> Column:
    """A column by its name as it is, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A row's columns as one struct, its fields named by place: no name of theirs can clash."""
    cells = [column(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c not in without]
    return F.struct(F.lit(True).alias("row"), *cells)


def unpacked(df: DataFrame, row: Column, instead: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``df`` out of a packed row, some replaced by others."""
    instead = instead or {}
    return [(instead[c] if c in instead else row.getField(f"c{i}")).alias(c) for i, c in enumerate(df.columns)]


def row_key(row_id: Column, text: Column) -> Column:
    """Equal for rows of the same id and text; nulls equal each other only."""
    name = row_id.cast("string")
    known = F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-"))
    return F.md5(F.concat(known, F.coalesce(F.concat(F.lit("+"), text), F.lit("-"))).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and
    all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cuts-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages neither
    recompute it nor depend on the executors that made it, and the planner
    knows its size.  The files go when the application ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/cuts-{sc.applicationId}/{next(_cut_number)}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def cut_bucketed(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """As :func:`cut`, in hash buckets of ``column``: joins on it move only the other side."""
    spark = df.sparkSession
    sc = spark.sparkContext
    number = next(_cut_number)
    path = f"{shared_dir(spark)}/cuts-{sc.applicationId}/{number}-{name}"
    known_as = "".join(c if c.isalnum() else "_" for c in f"cut_{sc.applicationId}_{number}_{name}")
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, column).saveAsTable(known_as)
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.table(known_as)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def as_bytes(column) -> F.Column:
    """Text for a Python worker: the UTF-8 bytes, without a decoding step."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def id_bucket(id_col: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (null ids: remainder of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
