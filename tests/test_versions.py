"""Versions, migrations and the store's own format."""

import pytest
from pyspark.sql import functions as F

from skein.operators import versions as V
from skein.sources import versioned


@pytest.fixture
def docs(spark):
    return spark.range(100).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 7).cast("double").alias("x"))


def pairs(df):
    return sorted((r.id, r.text) for r in df.collect())


def test_a_failed_batch_leaves_the_version_before(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert V.write(docs.filter("id < 10"), folder) == 1
    broken = lambda rows: rows.withColumn("text", F.when(F.col("id") == 55, F.raise_error(F.lit("planted"))).otherwise(F.col("text")))
    said = V.migrate(docs.filter("id >= 10"), folder, "id", 20, broken)
    assert said == {"status": "rolled_back", "migrated": 40, "failed": 20, "rolled_back": 40, "version": 1, "target_count": 10}
    assert V.versions(folder) == [1] and pairs(V.read(spark, folder)) == pairs(docs.filter("id < 10"))
    # What was staged is gone, but for what the failed write itself left.
    assert len(list((tmp_path / "store/data").iterdir())) <= 2
    kept = V.migrate(docs.filter("id >= 10"), folder, "id", 20, broken, rollback_on_failure=False)
    assert (kept["status"], kept["migrated"], kept["failed"], kept["target_count"]) == ("ok", 70, 20, 80)
    V.roll_back(folder, 1)
    assert V.migrate(docs.filter("id >= 10"), folder, "id", 20)["target_count"] == 100
    assert pairs(V.read(spark, folder)) == pairs(docs) and V.compared(docs, V.read(spark, folder), "id").first().mismatches == 0
    assert [r.version for r in V.history(spark, folder).orderBy("version").collect()] == [1, 2, 3, 4]


def test_batches_that_lose_rows_fail(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    said = V.migrate(docs, folder, "id", 30, lambda rows: rows.filter("id <> 70"))
    assert said["status"] == "rolled_back" and said["migrated"] == 60 and said["version"] == 0 and V.versions(folder) == []


def test_damage_is_found(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    V.write(docs, folder)
    assert V.verify(spark, folder) == []
    group = V.manifest(folder)["groups"][0]["path"]
    docs.withColumn("x", F.col("x") + 1).write.mode("overwrite").parquet(group)
    assert V.verify(spark, folder) == [group]
    V.drop({"path": group})
    assert V.verify(spark, folder) == [group]
    with pytest.raises(ValueError):
        V.read(spark, folder, 9)


def test_format_reads_and_writes_versions(spark, docs, tmp_path, capfd):
    folder = f"file://{tmp_path}/store"
    versioned.register(spark)
    by = lambda **o: spark.read.format("versions").option("path", folder).options(**o).load()
    docs.filter("id < 60").repartition(3).write.format("versions").option("path", folder).mode("append").save()
    docs.filter("id >= 60").write.format("versions").option("path", folder).mode("append").save()
    assert V.versions(folder) == [1, 2] and pairs(by()) == pairs(docs) and pairs(by(version=1)) == pairs(docs.filter("id < 60"))
    some = by().filter("id >= 20 AND id < 23 AND text IN ('text 20', 'text 22', 'text 99') AND x IS NOT NULL")
    assert pairs(some) == [(20, "text 20"), (22, "text 22")]
    capfd.readouterr()
    some.explain("formatted")
    pushed = next(line for line in capfd.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(id,20)" in pushed and "LessThan(id,23)" in pushed and "In(text" in pushed
    # What can't be pushed is filtered by Spark.
    assert by().filter("length(text) = 6 AND id % 2 = 0").count() == 5
    docs.filter("id < 5").write.format("versions").option("path", folder).mode("overwrite").save()
    assert pairs(by()) == pairs(docs.filter("id < 5")) and V.versions(folder) == [1, 2, 3] and V.verify(spark, folder) == []


def test_a_failed_write_makes_no_version(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    versioned.register(spark)
    V.write(docs, folder)
    broken = docs.repartition(3).withColumn("text", F.when(F.col("id") == 55, F.raise_error(F.lit("planted"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="planted|aborted|failed"):
        broken.write.format("versions").option("path", folder).mode("append").save()
    assert V.versions(folder) == [1] and pairs(V.read(spark, folder)) == pairs(docs)


def test_nothing_to_migrate(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    V.write(docs, folder)
    said = V.migrate(docs.limit(0), folder, "id", 10)
    assert (said["status"], said["migrated"], said["target_count"]) == ("ok", 0, 100)


def test_many_batches_take_few_jobs(spark, docs, tmp_path):
    many = spark.range(400).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    try:
        spark.sparkContext.setJobGroup("whole", "")
        assert V.migrate(many, f"file://{tmp_path}/whole", "id", 2)["target_count"] == 400
        assert 0 < jobs("whole") < 40
        # Two batches that fail, one of which loses as many rows as the other gains.
        moved = lambda rows: rows.filter("id <> 20").unionByName(rows.filter("id = 300"))
        said = V.migrate(many, f"file://{tmp_path}/moved", "id", 2, moved, rollback_on_failure=False)
        assert (said["status"], said["migrated"], said["failed"]) == ("ok", 396, 4)
        assert {r.id for r in many.join(V.read(spark, f"file://{tmp_path}/moved"), "id", "left_anti").collect()} == {20, 21, 300, 301}
        # Batches whose change drops the number of their batch are staged one by one.
        spark.sparkContext.setJobGroup("single", "")
        said = V.migrate(many, f"file://{tmp_path}/single", "id", 100, lambda rows: rows.select("id", "text"))
        assert said["migrated"] == 400 and len(V.manifest(f"file://{tmp_path}/single")["groups"]) == 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
