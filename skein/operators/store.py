"""A document store on Parquet: each change writes a new version beside the old one, so readers and lost tasks never
meet a half-written table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The layout of what is written; another one is refused.
LAYOUT = 1


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where none is set, a folder of this machine's."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    return f"file://{tempfile.mkdtemp(prefix='skein-')}"


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def save(df: DataFrame, key: str, folder: str | None = None) -> str:
    """Writes a version and returns its path; refuses a table in which a key stands twice."""
    if not df.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} stands twice")
    path = f"{folder or shared_folder(df.sparkSession)}/store-{uuid.uuid4().hex}"
    df.withColumn("_layout", F.lit(LAYOUT)).write.parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if "_layout" not in df.columns or not df.filter(F.col("_layout") != LAYOUT).isEmpty():
        raise ValueError(f"{path} has another layout")
    return df.drop("_layout")


def add(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The store with the rows of the batch whose key it doesn't hold."""
    return store.unionByName(batch.join(store.select(key), key, "left_anti"))


def update(store: DataFrame, where: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The changed store, and the rows that were changed, as RETURNING gives them."""
    hit = F.coalesce(where, F.lit(False))
    done = store.withColumn("_hit", hit).withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()})
    return done.drop("_hit"), done.filter("_hit").drop("_hit")


def delete_where(store: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """What is left, and what went."""
    hit = F.coalesce(where, F.lit(False))
    return store.filter(~hit), store.filter(hit)


def visible(rows: DataFrame, column: str, tenant: int | str, is_admin: bool = False) -> DataFrame:
    """The rows of a tenant; an administrator sees all."""
    return rows.filter((F.col(column) == tenant) | F.lit(is_admin))


def chunk_rows(chunks: DataFrame, text: str, metadata: str) -> DataFrame:
    """Chunks with their metadata as columns, each with its default."""
    given = lambda name: F.try_element_at(metadata, F.lit(name))
    return chunks.withColumns(
        {"chunk_type": F.coalesce(given("chunk_type"), F.lit("text")), "is_semantic": F.coalesce(given("is_semantic").cast("boolean"), F.lit(False)), "chunk_length": F.coalesce(given("chunk_length").cast("int"), F.length(text))}
    )


def restored(spark: SparkSession, versions: list[str]) -> DataFrame:
    """The newest version that can be read, as after a failed migration."""
    from pyspark.errors import PySparkException

    for path in reversed(versions):
        try:
            return load(spark, path)
        except (PySparkException, ValueError):
            continue
    raise ValueError("no version can be read")


def export_json(df: DataFrame, folder: str | None = None) -> str:
    path = f"{folder or shared_folder(df.sparkSession)}/export-{uuid.uuid4().hex}"
    df.write.json(path)
    return path


def import_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Lines of an export; one that isn't of the schema fails rather than being lost."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
