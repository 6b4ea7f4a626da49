"""Result files written by benchmark runs, read with explicit schemas: headers in the
wild disagree with the rows (7 names over 10 values, 6 over 5), so header names are
never trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

D, L, S = T.DoubleType(), T.LongType(), T.StringType()

# Column names and order of each result file kind.
RESULT_SCHEMAS = {
    "microbenchmark": [("time", D), ("num_spill_objs", L), ("spilled_size", D), ("migration_count", L),
                       ("working_set", L), ("object_store_size", D), ("object_size", D), ("std", D), ("var", D)],
    "sort": [("runtime", D), ("spilled_amount", S), ("migration_count", L), ("spilled_objects", S),
             ("write_throughput", S), ("restored_amount", S), ("restored_objects", S),
             ("read_throughput", S), ("num_partitions", L), ("partition_size", D)],
    "config_sweep": [("object_store_size", D), ("num_workers", L), ("num_partitions", L),
                     ("partition_size", D), ("runtime", D)],
    "video": [("mean_latency", D), ("max_latency", D), ("runtime", D), ("spilled_size", D),
              ("migration_count", L)],
    "serving": [("runtime", D), ("num_batches", L), ("batch_size", L), ("batch_interval", D),
                ("models_run", L), ("spilled", D), ("restored", D), ("object_store_size", D)],
}


def result_schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in RESULT_SCHEMAS[kind]])


def read_results(spark: SparkSession, path: str, kind: str, header: bool = True) -> DataFrame:
    """Read result CSVs; a header line, if present, is skipped but not used for names."""
    return (spark.read.schema(result_schema(kind)).option("header", header)
            .option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path))
