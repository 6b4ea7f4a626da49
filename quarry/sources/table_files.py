"""A Python data source over the Parquet files of a table:
``spark.read.format("table_files").option("path", p)``.

Read tasks are planned from the files' footers: row groups whose statistics contradict a pushed
filter are left out, the others are packed into tasks of about ``rows_per_task`` rows. Pushed
filters are applied exactly while a row group is read; what cannot be pushed (nested columns,
types other than whole numbers, strings, dates and booleans, float comparisons in which Spark
counts NaN) goes back to Spark. ``option("columns", "a,b")`` prunes columns.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual)

from quarry.sources.files import filesystem

ROWS_PER_TASK = 1_000_000


@dataclass
class RowGroups(InputPartition):
    groups: list  # (file, row group)

    def __post_init__(self) -> None:
        super().__init__(None)


def _table_files(path: str) -> tuple:
    """The file system and the names of the Parquet files of a file or folder."""
    from pyarrow import fs
    files, root = filesystem(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return files, [root]
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return files, sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet")
                         and not f.base_name.startswith(("_", ".")))


def excluded(f: Filter, stats) -> bool:
    """No row of a row group with these column statistics passes the filter."""
    if isinstance(f, IsNotNull):
        return stats.has_null_count and stats.null_count == stats.num_values + stats.null_count and stats.null_count > 0
    if not stats.has_min_max:
        return False
    lo, hi = stats.min, stats.max
    if isinstance(f, In):
        return all(v < lo or v > hi for v in f.value)
    return {EqualTo: f.value < lo or f.value > hi, LessThan: lo >= f.value, LessThanOrEqual: lo > f.value,
            GreaterThan: hi <= f.value, GreaterThanOrEqual: hi < f.value}[type(f)]


class TableReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], rows_per_task: int):
        self.path, self.columns, self.rows_per_task, self.filters = path, columns, rows_per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        files, names = _table_files(self.path)
        with files.open_input_file(names[0]) as f:
            schema = pq.read_schema(f)
        for f in filters:
            if not self._can(f, schema, pa):
                yield f
                continue
            self.filters.append(f)

    def _can(self, f: Filter, schema, pa) -> bool:
        if not isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual, IsNotNull)):
            return False
        if len(f.attribute) != 1 or f.attribute[0] not in schema.names:
            return False
        kind = schema.field(f.attribute[0]).type
        if isinstance(f, IsNotNull):
            return not pa.types.is_nested(kind)
        values = list(f.value) if isinstance(f, In) else [f.value]
        if pa.types.is_floating(kind):  # Spark counts NaN as the largest value and as equal to itself
            return isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and all(isinstance(v, float) and v == v for v in values)
        expected = int if pa.types.is_integer(kind) else str if pa.types.is_string(kind) else \
            datetime.date if pa.types.is_date(kind) else bool if pa.types.is_boolean(kind) else None
        return expected is not None and all(type(v) is expected for v in values)

    def partitions(self) -> list[RowGroups]:
        import pyarrow.parquet as pq
        files, names = _table_files(self.path)

        def groups(name: str) -> list[tuple[str, int, int]]:
            with files.open_input_file(name) as f:
                meta = pq.read_metadata(f)
            at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            out = []
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                stats = [(f, group.column(at[f.attribute[0]]).statistics) for f in self.filters]
                if not any(s is not None and excluded(f, s) for f, s in stats):
                    out.append((name, g, group.num_rows))
            return out

        with ThreadPoolExecutor(16) as pool:
            found = [x for one in pool.map(groups, names) for x in one]
        tasks, now, rows = [], [], 0
        for name, g, n in found:
            now.append((name, g))
            rows += n
            if rows >= self.rows_per_task:
                tasks.append(RowGroups(now))
                now, rows = [], 0
        return [*tasks, RowGroups(now)] if now or not tasks else tasks

    def read(self, partition: RowGroups) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        compare = {EqualTo: pc.equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal, GreaterThan: pc.greater,
                   GreaterThanOrEqual: pc.greater_equal}
        files, _ = filesystem(self.path)
        wanted = list(dict.fromkeys([*self.columns, *(f.attribute[0] for f in self.filters)]))
        for name, g in partition.groups:
            with files.open_input_file(name) as source:
                for batch in pq.ParquetFile(source).iter_batches(row_groups=[g], columns=wanted):
                    for f in self.filters:
                        col = batch.column(f.attribute[0])
                        if isinstance(f, IsNotNull):
                            keep = col.is_valid()
                        elif isinstance(f, In):
                            keep = pc.is_in(col, pa.array(list(f.value), col.type))
                        else:
                            keep = compare[type(f)](col, pa.scalar(f.value, col.type))
                        batch = batch.filter(keep)
                    if batch.num_rows:
                        yield batch.select(self.columns)


class TableFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "table_files"

    def schema(self):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema
        files, names = _table_files(self.options["path"])
        with files.open_input_file(names[0]) as f:
            schema = pq.read_schema(f)
        wanted = self.options.get("columns")
        return from_arrow_schema(pa.schema([schema.field(c) for c in wanted.split(",")]) if wanted else schema.remove_metadata(),
                                 prefer_timestamp_ntz=True)

    def reader(self, schema) -> TableReader:
        return TableReader(self.options["path"], schema.names, int(self.options.get("rows_per_task", ROWS_PER_TASK)))


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The table's columns through the source, with filters pushed into it."""
    spark.dataSource.register(TableFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("table_files").option("columns", ",".join(columns)).load(path)
