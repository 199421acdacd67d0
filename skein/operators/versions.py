"""A store with versions: Parquet files, and manifests that say which of them count.

A version is one manifest, a small JSON file that appears whole (written under another name, then renamed): that is the one
point at which a change counts.  Files that no manifest names are left-overs of changes that failed and are never read.
One writer at a time.  Each file group of a manifest has its rows and a checksum, by which :func:`verify` finds damage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.operators.aggregation import ranked
from skein.operators.store import shared_folder


def files_of(folder: str):
    """File system and path of a folder, on the driver and in tasks alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def new_store(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"


def versions(folder: str) -> list[int]:
    """Numbers of the versions, ascending."""
    from pyarrow import fs

    files, path = files_of(folder)
    found = files.get_file_info(fs.FileSelector(f"{path}/manifests", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


def manifest(folder: str, version: int | None = None) -> dict:
    """Of a version, the newest if none is named: version, schema (JSON), groups (path, rows, checksum) and a note."""
    held = versions(folder)
    if not held or (version is not None and version not in held):
        raise ValueError(f"{folder} has no version {'' if version is None else version}")
    files, path = files_of(folder)
    with files.open_input_file(f"{path}/manifests/{version or held[-1]:08d}.json") as f:
        return json.loads(f.read())


def commit(folder: str, schema: str, groups: list[dict], note: str) -> int:
    """Makes a version of the groups; its number."""
    number = (versions(folder) or [0])[-1] + 1
    files, path = files_of(folder)
    files.create_dir(f"{path}/manifests", recursive=True)
    under = f"{path}/manifests/{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(under) as out:
        out.write(json.dumps({"version": number, "schema": schema, "groups": groups, "note": note}).encode())
    files.move(under, f"{path}/manifests/{number:08d}.json")
    return number


def checksum(rows: DataFrame) -> list[Column]:
    """Rows, and a sum over hashes of whole rows that doesn't depend on their order."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("checksum")]


def stage(rows: DataFrame, folder: str, path: str | None = None) -> dict:
    """Writes a group of files that doesn't count yet, and what is found on reading it again."""
    path = path or f"{folder}/data/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    found = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return {"path": path, **found.agg(*checksum(found)).first().asDict()}


def drop(group: dict) -> None:
    files, path = files_of(group["path"])
    # A write that failed may have left no folder.
    if files.get_file_info(path).type.name != "NotFound":
        files.delete_dir(path)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    said = manifest(folder, version)
    schema = StructType.fromJson(json.loads(said["schema"]))
    paths = [g["path"] for g in said["groups"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write(rows: DataFrame, folder: str, note: str = "", append: bool = False) -> int:
    """A version with these rows, and with those of the version before if they are appended."""
    groups = manifest(folder)["groups"] if append and versions(folder) else []
    return commit(folder, rows.schema.json(), [*groups, stage(rows, folder)], note)


def roll_back(folder: str, version: int, note: str = "rolled back") -> int:
    """A new version that is what an earlier one was."""
    said = manifest(folder, version)
    return commit(folder, said["schema"], said["groups"], note)


def verify(spark: SparkSession, folder: str, version: int | None = None) -> list[str]:
    """Paths of the groups whose rows or checksum aren't those of the manifest, or that can't be read."""
    said = manifest(folder, version)
    schema, bad = StructType.fromJson(json.loads(said["schema"])), []
    for g in said["groups"]:
        try:
            found = spark.read.schema(schema).parquet(g["path"])
            now = found.agg(*checksum(found)).first().asDict()
        except PySparkException:
            now = {}
        if any(g[k] is not None and now.get(k) != g[k] for k in ("rows", "checksum")):
            bad.append(g["path"])
    return bad


def migrate(source: DataFrame, folder: str, key: str, batch_size: int, change: Callable[[DataFrame], DataFrame] | None = None, rollback_on_failure: bool = True, note: str = "migrated") -> dict:
    """Adds the rows of ``source`` to the store in batches of ``batch_size`` by ``key``, each passed through ``change``.

    Runs of batches are staged and read again together, and a run that fails is halved until the batch that fails is found,
    so the number of jobs grows with the failures and not with the batches.  ``change`` gets the rows of several batches, told
    apart by a column ``_batch``; one that drops it gets every batch by itself.  The version that holds them all is committed
    once, at the end.  If a batch fails, the staged ones are removed and the version before stays the current one; without
    ``rollback_on_failure`` the batches that succeeded are committed.  Returns status, migrated, failed, rolled_back,
    version and target_count."""
    spark = source.sparkSession
    # Written once, in the order of the batches, so that files without a run's batches are skipped.
    held = {"path": f"{folder}/batches/{uuid.uuid4().hex}"}
    ranked(source.withColumn("_all", F.lit(0)), ["_all"], [key]).withColumn("_batch", F.floor(F.col("_i") / batch_size).cast("long")).drop("_all", "_i", "_n").write.parquet(held["path"])
    dealt = spark.read.schema(StructType.fromJson(source.schema.jsonValue()).add("_batch", "long")).parquet(held["path"])
    total = dealt.count()
    staged, failed = [], 0

    def whole(first: int, stop: int) -> dict | None:
        """What was staged of a run of batches, if every batch of it has its rows."""
        rows = dealt.filter((F.col("_batch") >= first) & (F.col("_batch") < stop))
        path = f"{folder}/data/{uuid.uuid4().hex}"
        try:
            changed = change(rows) if change else rows
            if "_batch" not in changed.columns and stop - first > 1:
                return None
            group = stage(changed.drop("_batch"), folder, path)
            size = F.least(F.lit(batch_size), F.lit(total) - F.col("_batch") * batch_size)
            if group["rows"] == min(stop * batch_size, total) - first * batch_size and (stop - first == 1 or changed.groupBy("_batch").count().filter(F.col("count") != size).isEmpty()):
                return group
        except PySparkException:
            pass
        drop({"path": path})
        return None

    # Runs yet to be tried, the next one last.
    batches, status = -(-total // batch_size), "ok"
    ahead = [(0, batches)] if batches else []
    while ahead:
        first, stop = ahead.pop()
        if group := whole(first, stop):
            staged.append(group)
        elif stop - first > 1:
            middle = (first + stop) // 2
            ahead += [(middle, stop), (first, middle)]
        else:
            failed += min(stop * batch_size, total) - first * batch_size
            if rollback_on_failure:
                status = "rolled_back"
                break
    migrated = sum(g["rows"] for g in staged)
    if status == "ok":
        before = manifest(folder) if versions(folder) else {"groups": []}
        schema = (change(source) if change else source).schema.json()
        version = commit(folder, schema, [*before["groups"], *staged], note)
    else:
        for g in staged:
            drop(g)
        version = (versions(folder) or [0])[-1]
    drop(held)
    target = read(spark, folder, version).count() if version else 0
    return {"status": status, "migrated": migrated, "failed": failed, "rolled_back": migrated if status == "rolled_back" else 0, "version": version, "target_count": target}


def compared(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(source_count, target_count, mismatches): keys that one side lacks or whose rows differ."""
    side = lambda df, name: df.select(key, F.xxhash64(*sorted(df.columns)).alias(name))
    both = side(source, "_a").join(side(target, "_b"), key, "full")
    return both.agg(F.count("_a").alias("source_count"), F.count("_b").alias("target_count"), F.coalesce(F.sum((~F.col("_a").eqNullSafe(F.col("_b"))).cast("long")), F.lit(0)).alias("mismatches"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(version, note, groups, rows) of every version."""
    held = [manifest(folder, v) for v in versions(folder)]
    return spark.createDataFrame([(m["version"], m["note"], len(m["groups"]), sum(g["rows"] for g in m["groups"])) for m in held], "version long, note string, groups long, rows long")


def latest_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, as a store shows it to which newer rows are appended."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_k = 1").drop("_k")
