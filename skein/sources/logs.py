"""Log lines: 'time | LEVEL | logger:function:line | message'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = "yyyy-MM-dd HH:mm:ss"


def parse(line: Column) -> Column:
    """A struct; null for lines of another form.  The bars part a line in four, the message keeping its own; the third
    part is three names between colons, the last of them a number."""
    parts = F.transform(F.split(line, r"\|", 4), lambda x: F.trim(x))
    at = F.split(F.get(parts, 2), ":")
    time, number = F.try_to_timestamp(F.get(parts, 0), F.lit(TIME)), F.get(at, 2).try_cast("int")
    right = (F.size(parts) == 4) & time.isNotNull() & (F.size(at) == 3) & number.isNotNull() & (F.get(parts, 1) != "")
    return F.when(right, F.struct(time.alias("ts"), F.get(parts, 1).alias("level"), F.get(at, 0).alias("logger"), F.get(at, 1).alias("function"), number.alias("line"), F.get(parts, 3).alias("message")))


def read(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(parse(F.col("value")).alias("x")).filter("x is not null").select("x.*")


def follow(spark, path: str) -> DataFrame:
    """The same as a stream; each line is read once."""
    return spark.readStream.text(path).select(parse(F.col("value")).alias("x")).filter("x is not null").select("x.*")
