"""Streams over staged files, and running one to its end.

``stage`` writes rows as files in arrival order, each of bounded size, so their number grows with
the data. The file source takes files by modification time; the times are set in the order of the
file names, so later rows never overtake earlier ones and a watermark drops nothing. ``drain``
still counts what a watermark dropped, and raises if that is not zero: no row disappears
unnoticed.
"""

from __future__ import annotations

import math
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

#: Rows of a staged file; files of a trigger at most; triggers that a short stream is spread over.
FILE_ROWS, TRIGGER_FILES, TRIGGERS = 1_000_000, 64, 4
#: Staged bytes per state store.
STORE_BYTES = 8 << 20

#: Buckets that keys are dealt into. A call costs far more than a key's own work, so one call takes all
#: new rows of a bucket's keys. A checkpoint goes with this number.
BUCKETS = 1024

#: State stores of the keyed operators: typed state variables need RocksDB; changelogs make a
#: commit write what changed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def data_files(spark: SparkSession, folder: str) -> list:
    """The statuses of a folder's data files, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((f for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))),
                  key=lambda f: f.getPath().getName())


def stage(df: DataFrame, order: list[str], folder: str | None = None, file_rows: int = FILE_ROWS) -> str:
    """Append the rows to ``folder`` (default: a fresh one) as files in ``order``."""
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "stream-src")
    try:
        before = data_files(spark, folder)
    except Exception:  # noqa: BLE001 - the folder does not exist yet
        before = []
    known = {f.getPath().getName() for f in before}
    n = max(TRIGGERS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("append") \
        .option("maxRecordsPerFile", file_rows).parquet(folder)
    at = max([f.getModificationTime() for f in before], default=int(time.time() * 1000) - 10_000_000)
    for f in (f for f in data_files(spark, folder) if f.getPath().getName() not in known):
        at += 1000
        f.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(f.getPath(), at, -1)
    return folder


def read_staged(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The folder as a stream: its present files in at least ``TRIGGERS`` triggers (if it has as many)
    of at most ``TRIGGER_FILES`` files."""
    per = min(TRIGGER_FILES, max(1, math.ceil(len(data_files(spark, folder)) / TRIGGERS)))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(folder)


def heartbeat(spark: SparkSession, schema, ts: str, at) -> DataFrame:
    """One row that carries nothing but a time: it moves the watermark past all timers due before."""
    names = [f.name for f in schema.fields]
    one = spark.range(1)
    return one.select(*[(F.lit(at) if c == ts else F.lit(None)).cast(schema[c].dataType).alias(c) for c in names])


@contextmanager
def sized_stores(spark: SparkSession, folder: str):
    """For an input that is all staged: a state store per ``STORE_BYTES`` of it, eight at least and
    ``spark.sql.shuffle.partitions`` at most. A checkpoint keeps the number it began with, so streams
    that go on growing take the session's setting."""
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    size = sum(f.getLen() for f in data_files(spark, folder))
    spark.conf.set(name, str(min(int(old), max(8, math.ceil(size / STORE_BYTES)))))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def keyed(stream: DataFrame, key: str, processor, out: str, time_mode: str) -> DataFrame:
    """``transformWithStateInPandas`` by one key. The processor travels by value: Spark also starts it
    in a Python process of the driver, which does not have the files that executors are sent."""
    from pyspark import cloudpickle
    modules = [sys.modules[c.__module__] for c in type(processor).__mro__ if c.__module__.startswith("quarry.")] + [sys.modules[__name__]]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        return stream.groupBy(key).transformWithStateInPandas(processor, out, "append", time_mode)
    finally:
        for m in dict.fromkeys(modules):
            cloudpickle.unregister_pickle_by_value(m)


def bucketed(stream: DataFrame, key: str, processor, out: str, time_mode: str) -> DataFrame:
    """``keyed`` by the bucket of ``key``: the processor is called with many keys at once."""
    return keyed(stream.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), "bucket", processor, out, time_mode)


def by_key(pdf: pd.DataFrame, key: str, order: str) -> Iterator[tuple]:
    """(key, its rows in the order of ``order``) of a frame; a missing key is None, and comes first."""
    keys, places = pdf[key], pdf[order].to_numpy(np.int64)
    null = keys.isna().to_numpy()
    ids = keys.where(~null, 0).to_numpy(np.int64)
    at = np.lexsort((places, ids, ~null))
    cuts = np.flatnonzero(np.diff(ids[at]) | np.diff(null[at])) + 1
    for rows in np.split(at, cuts) if len(at) else ():
        yield None if null[rows[0]] else int(ids[rows[0]]), rows


def lots(rows: Iterator[pd.DataFrame], size: int = 200_000) -> Iterator[pd.DataFrame]:
    """The frames of a call in lots of about ``size`` rows."""
    held, n = [], 0
    for pdf in rows:
        held, n = [*held, pdf], n + len(pdf)
        if n >= size:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def drain(stream: DataFrame, checkpoint: str, out: str | None = None, each_batch=None) -> list:
    """Process all that the checkpoint has not seen, stop, and return the progress reports. What is
    processed goes to Parquet files in ``out`` (exactly once) or to ``each_batch(df, epoch)``."""
    spark = stream.sparkSession
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
        q = (w.foreachBatch(each_batch).start() if each_batch else w.format("parquet").start(out))  # takes a copy of the settings
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    q.awaitTermination()
    reports = list(q.recentProgress)
    dropped = sum(op["numRowsDroppedByWatermark"] for p in reports for op in p["stateOperators"])
    if dropped:
        raise RuntimeError(f"{dropped} rows arrived behind the watermark and were dropped")
    return reports
