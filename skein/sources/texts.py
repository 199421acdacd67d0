"""Text files and inline texts: what a source string is, and how its texts become rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.versions import files_of

LONGEST_PATH = 500
#: Bytes and files that are handed over at once.
BYTES, FILES = 1 << 22, 1024
EXTENSION = r"\.[\p{L}\p{N}]{1,10}$"


def is_path(source: Column) -> Column:
    """A path has a separator, or an ending of one to ten letters or digits and no space, and under 500 characters."""
    ending = source.rlike(EXTENSION) & ~F.contains(source, F.lit(" "))
    return (F.contains(source, F.lit("/")) | F.contains(source, F.lit("\\")) | ending) & (F.length(source) < LONGEST_PATH)


def load(spark: SparkSession, source: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, text): every file that a path or pattern names, whole; another string is a text itself, without a path.
    Bytes that the encoding doesn't know are replaced; but a file with no character beyond ASCII that is whole in UTF-8
    isn't UTF-8, and is read as ISO-8859-1."""
    named = ("/" in source or "\\" in source or (re.search(r"\.\w{1,10}$", source) and " " not in source)) and len(source) < LONGEST_PATH
    if not named:
        return spark.createDataFrame([(None, source)], "path string, text string")
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source), encoding)


def decoded(files: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """(path, text) of files (path, content), by the rule of :func:`load`."""
    if encoding.upper().replace("-", "") == "UTF8":
        read = files.select("path", "content", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        other = F.contains("text", F.lit("\ufffd")) & ~F.col("text").rlike("[^\\x00-\\x7F\ufffd]")
        return read.select("path", F.when(other, F.decode("content", "ISO-8859-1")).otherwise(F.col("text")).alias("text"))

    # Not decode(): that refuses a text with a single wrong byte.
    @F.pandas_udf("string")
    def replaced(content: pd.Series) -> pd.Series:
        return content.map(lambda b: b.decode(encoding, "replace"))

    return files.select("path", replaced("content").alias("text"))


def write_tree(files: DataFrame, folder: str) -> int:
    """Writes each row (path below the folder, text) as a file, by its tasks; their number.  A file appears whole, and a task
    that runs again writes the same ones.  No path comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = files_of(folder)
        made: set[str] = set()
        n = 0
        for b in batches:
            for path, text in zip(b.column("path"), b.column("text"), strict=True):
                within, _, name = f"{top}/{path.as_py()}".rpartition("/")
                if within not in made:
                    system.create_dir(within, recursive=True)
                    made = {within} if len(made) > FILES else made | {within}
                with system.open_output_stream(under := f"{within}/.{uuid.uuid4().hex}") as out:
                    out.write((text.as_py() or "").encode())
                system.move(under, f"{within}/{name}")
                n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    return files.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def load_tree(spark: SparkSession, folder: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, text) of every file below a folder, whole, as :func:`load` reads them; names that begin with a dot or an
    underscore are left out, as there.

    Tasks list the folders: the first two levels one after the other, and what is below a folder of the second by the task
    that reads its files.  So neither the list of files nor a task a file is the driver's, however many files there are."""

    def listed(batches: Iterator[pa.RecordBatch], recursive: bool) -> Iterator[tuple[str, bool]]:
        from pyarrow import fs

        system, _ = files_of(folder)
        seen = lambda f: not f.base_name.startswith((".", "_"))
        for b in batches:
            for path, whole in zip(b.column("path").to_pylist(), b.column("whole").to_pylist(), strict=True):
                below = [(path, whole)]
                while below:
                    path, whole = below.pop()
                    if whole:
                        yield path, True
                        continue
                    for f in filter(seen, system.get_file_info(fs.FileSelector(path))):
                        if recursive and f.type == fs.FileType.Directory:
                            below.append((f.path, False))
                        else:
                            yield f.path, f.type != fs.FileType.Directory

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bool]] = []
        for x in listed(batches, recursive=False):
            held.append(x)
            if len(held) == FILES:
                yield pa.record_batch([pa.array(c) for c in zip(*held, strict=True)], names=["path", "whole"])
                held = []
        if held:
            yield pa.record_batch([pa.array(c) for c in zip(*held, strict=True)], names=["path", "whole"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = files_of(folder)
        names, held, size = [], [], 0
        for path, _ in listed(batches, recursive=True):
            with system.open_input_stream(path) as source:
                held.append(source.read())
            names.append(path)
            size += len(held[-1])
            if size > BYTES or len(held) == FILES:
                yield pa.record_batch([pa.array(names), pa.array(held, pa.binary())], names=["path", "content"])
                names, held, size = [], [], 0
        if held:
            yield pa.record_batch([pa.array(names), pa.array(held, pa.binary())], names=["path", "content"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.createDataFrame([(files_of(folder)[1], False)], "path string, whole boolean").coalesce(1)
    for _ in range(2):
        found = found.mapInArrow(level, "path string, whole boolean").repartition(parts, "path")
    return decoded(found.mapInArrow(read, "path string, content binary"), encoding)


def paragraphs(text: Column) -> Column:
    """The parts between blank lines, without line ends around them; empty ones stay."""
    return F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\n+|\n+$", ""))


#: Fixed value: what ends a sentence, in four scripts.
SENTENCE_END = r"(?<=[.!?\x{061F}\x{061B}\x{060C}\x{3002}\x{FF01}\x{FF1F}])\s+"


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def variables(template: Column) -> Column:
    """Names in braces of a prompt template, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A prompt from a template; a name without a value stays as it is."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out
