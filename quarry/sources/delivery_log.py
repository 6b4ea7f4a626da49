"""An exactly-once sink: ``df.write.format("delivery_log")`` and ``df.writeStream.format(...)``.

Tasks write files under names of their own; a commit lists them in the ledger file of its epoch,
which appears at once under its final name. Only listed files are ever read. So a killed attempt
leaves nothing that counts, and an epoch that is delivered again finds its ledger file and adds
nothing. Rows are written as Parquet, or, with ``option("lines", "true")``, as text lines
``<first column> <second column>``.

``option("epoch", n)`` numbers a batch write; a stream's epochs are its micro-batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from quarry.sources.files import filesystem


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Log:
    """What the writers of batches and streams share."""

    def __init__(self, path: str, lines: bool):
        self.path, self.lines = path.rstrip("/"), lines

    def _ledger(self, epoch: int) -> str:
        return f"ledger/epoch-{epoch:012d}.json"

    def _committed(self, epoch: int) -> bool:
        from pyarrow import fs
        files, root = filesystem(self.path)
        return files.get_file_info(f"{root}/{self._ledger(epoch)}").type != fs.FileType.NotFound

    def write(self, iterator: Iterator) -> Written:
        import pyarrow.csv as csv
        import pyarrow.parquet as pq
        files, root = filesystem(self.path)
        files.create_dir(f"{root}/data", recursive=True)
        name, out, writer, rows = f"{uuid.uuid4().hex}.{'txt' if self.lines else 'parquet'}", None, None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                out = files.open_output_stream(f"{root}/data/{name}")
                writer = csv.CSVWriter(out, batch.schema, write_options=csv.WriteOptions(
                    include_header=False, delimiter=" ", quoting_style="none")) if self.lines else pq.ParquetWriter(out, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return Written(None, 0)
        writer.close()
        out.close()
        return Written(name, rows)

    def finish(self, messages: list, epoch: int) -> None:
        listed = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.name]
        if self._committed(epoch):  # a replay
            self.drop(messages)
            return
        files, root = filesystem(self.path)
        files.create_dir(f"{root}/ledger", recursive=True)
        hidden = f"{root}/ledger/.{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as f:
            f.write(json.dumps({"epoch": epoch, "files": listed}).encode() + b"\n")
        files.move(hidden, f"{root}/{self._ledger(epoch)}")

    def drop(self, messages: list) -> None:
        """Files that no ledger lists are never read; those that are known go at once."""
        files, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{root}/data/{m.name}")


class BatchLog(_Log, DataSourceArrowWriter):
    def __init__(self, path: str, lines: bool, epoch: int):
        _Log.__init__(self, path, lines)
        self.epoch = epoch

    def write(self, iterator: Iterator) -> Written:
        # a replayed epoch does not even write
        return Written(None, 0) if self._committed(self.epoch) else super().write(iterator)

    def commit(self, messages: list) -> None:
        self.finish(messages, self.epoch)

    def abort(self, messages: list) -> None:
        self.drop(messages)


class StreamLog(_Log, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.finish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.drop(messages)


class DeliveryLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delivery_log"

    def _options(self) -> tuple[str, bool]:
        return self.options["path"], self.options.get("lines", "false").lower() == "true"

    def writer(self, schema, overwrite: bool) -> BatchLog:
        if overwrite:
            raise ValueError("a delivery log is only appended to")
        return BatchLog(*self._options(), int(self.options["epoch"]))

    def streamWriter(self, schema, overwrite: bool) -> StreamLog:
        return StreamLog(*self._options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DeliveryLog)


def append(df: DataFrame, path: str, epoch: int, lines: bool = False) -> None:
    """Deliver the rows as one epoch; nothing happens if the log has that epoch."""
    register(df.sparkSession)
    df.write.format("delivery_log").mode("append").option("epoch", epoch).option("lines", str(lines).lower()).save(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """epoch, name and rows of every listed file."""
    files = spark.read.schema("epoch long, files array<struct<name: string, rows: long>>").json(f"{path}/ledger")
    return files.select("epoch", F.inline("files"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The delivered rows with their ``epoch``. The driver holds the names of the listed files, as it
    does for any table it reads."""
    listed = ledger(spark, path)
    names = [f"{path}/data/{r['name']}" for r in listed.select("name").collect()]
    lines = any(n.endswith(".txt") for n in names)
    rows = spark.read.schema("value string").text(names) if lines else spark.read.schema(schema).parquet(*names) if names \
        else spark.createDataFrame([], schema)
    if not names:
        return rows.withColumn("epoch", F.lit(None).cast("long"))
    if lines:
        first, second = schema.split(",")
        part = F.split("value", " ")
        rows = rows.select(*[part[i].try_cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate((first.strip(), second.strip()))],
                           F.col("_metadata.file_name").alias("_file"))
    else:
        rows = rows.select("*", F.col("_metadata.file_name").alias("_file"))
    of = listed.select("epoch", F.col("name").alias("_name"))
    return rows.join(of, rows["_file"] == of["_name"]).drop("_file", "_name")


def first_deliveries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of its first epoch (of several there, the smallest)."""
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    one = F.min(F.struct("epoch", *rest)).alias("_first")
    return rows.groupBy(*keys).agg(one).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
