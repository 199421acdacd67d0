"""The versioned store as a Spark data source: ``spark.read.format("versions").option("path", folder)``.

After ``spark.dataSource.register(VersionedSource)`` the store is read and written by format, from SQL too.  A read is one
partition for each row group of the current version's files (option ``version``: of that one); comparisons with literals are
pushed down and skip row groups by their statistics, and rows inside.  A write stages a file a task and commits one manifest
when all tasks are done; what failed tasks staged is removed or, if the driver is lost, never named.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from skein.operators import versions as V

#: Filters that a read takes over, and how Arrow says them.
COMPARED = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


@dataclass
class RowGroup(InputPartition):
    path: str
    number: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class VersionedReader(DataSourceReader):
    def __init__(self, folder: str, version: int | None, schema: StructType) -> None:
        self.folder, self.version, self.columns, self.tests = folder, version, schema.names, []

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            plain = type(f) in COMPARED and isinstance(f.value, (int, float, str)) or isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value) or isinstance(f, IsNotNull)
            if plain and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], COMPARED.get(type(f), type(f).__name__), getattr(f, "value", None)))
            else:
                yield f

    def _test(self):
        import pyarrow.compute as pc

        def one(name, how, value):
            if how == "IsNotNull":
                return pc.field(name).is_valid()
            return pc.field(name).isin(list(value)) if how == "In" else getattr(pc.field(name), how)(value)

        return reduce(lambda a, b: a & b, [one(*t) for t in self.tests]) if self.tests else None

    def partitions(self) -> list[InputPartition]:
        import pyarrow.dataset as ds

        found: list[InputPartition] = []
        for g in V.manifest(self.folder, self.version)["groups"]:
            files, path = V.files_of(g["path"])
            for piece in ds.dataset(path, filesystem=files, format="parquet", exclude_invalid_files=False).get_fragments():
                for part in piece.split_by_row_group(self._test()):
                    found.append(RowGroup(part.path, part.row_groups[0].id))
        return found or [RowGroup("", -1)]

    def read(self, partition: RowGroup) -> Iterator:
        if partition.number < 0:
            return
        import pyarrow.dataset as ds

        files, _ = V.files_of(self.folder)
        piece = ds.ParquetFileFormat().make_fragment(partition.path, filesystem=files, row_groups=[partition.number])
        yield from piece.to_batches(columns=self.columns, filter=self._test())


class VersionedWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool) -> None:
        self.folder, self.schema, self.overwrite = folder, schema.json(), overwrite
        self.group = f"{folder}/data/{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        import pyarrow.parquet as pq

        files, path = V.files_of(self.group)
        files.create_dir(path, recursive=True)
        name, out, rows = f"{path}/{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(name, batch.schema, filesystem=files)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(name if out is not None else "", rows)

    def commit(self, messages) -> None:
        """Files of attempts that don't count go, then the version appears."""
        from pyarrow import fs

        files, path = V.files_of(self.group)
        named = {m.path for m in messages if m is not None and m.path}
        for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.path not in named:
                files.delete_file(f.path)
        before = V.manifest(self.folder)["groups"] if not self.overwrite and V.versions(self.folder) else []
        made = [{"path": self.group, "rows": sum(m.rows for m in messages if m is not None), "checksum": None}] if named else []
        V.commit(self.folder, self.schema, [*before, *made], "written by format")

    def abort(self, messages) -> None:
        from pyarrow import fs

        files, path = V.files_of(self.group)
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_dir(path)


class VersionedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "versions"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(V.manifest(self.options["path"], self._version())["schema"]))

    def _version(self) -> int | None:
        said = self.options.get("version")
        return int(said) if said else None

    def reader(self, schema: StructType) -> VersionedReader:
        return VersionedReader(self.options["path"], self._version(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> VersionedWriter:
        return VersionedWriter(self.options["path"], schema, overwrite)


def register(spark) -> None:
    """Makes the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VersionedSource)
