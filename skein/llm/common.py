"""What the operators share: reading tables, the shared scratch folder, and Arrow batches cut to a byte bound."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.store import shared_folder

#: Spark's string of the characters that separate words: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task holds in numpy form at once.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(parts: int, name: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8")) % parts


def row_key() -> Column:
    """A key of a row's id and text: joins on it keep rows apart that share an id by mistake, null ids included."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-(2**62))), F.col("text"))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only in local mode one is made where none is named (tests)."""
    context = spark.sparkContext
    named = shared_folder(spark)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def chunks(rows: Iterable[tuple], size: int = CHUNK_BYTES, at: int = 1) -> Iterator[list[tuple]]:
    """Lists of rows whose field ``at`` adds up to about ``size`` bytes; a longer row is a list of its own."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        if held and total + len(row[at]) > size:
            yield held
            held, total = [], 0
        held.append(row)
        total += len(row[at])
    if held:
        yield held


def give_back() -> None:
    """Returns freed memory to the system at a task's end: workers live on, and the next stage needs room as well."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def add_from_text(docs: DataFrame, name: str, kind: str, arrow: pa.DataType, make) -> DataFrame:
    """All rows and columns of ``docs`` with one more, in whole batches: ``make()`` is called once in each task and
    returns a function from a list of texts in UTF-8 to a list or array of values."""
    columns = [f"d{k}" for k in range(len(docs.columns))]
    inner, place = docs.toDF(*columns), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = make()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value([t or b"" for t in as_bytes(part.column(place))]), arrow)], names=[*columns, "value"])
        give_back()

    kinds = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in columns)
    return inner.mapInArrow(run, f"{kinds}, value {kind}").toDF(*docs.columns, name)
