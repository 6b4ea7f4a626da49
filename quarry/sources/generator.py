"""Generated int64 rows as a Python data source: ``spark.read.format("random_rows")``.

Rows are split into read tasks of ``max(1, n // parallelism)`` rows (the last may be
short); column j of row i is the LCG applied j+1 times to i, so any task can be re-run
after an executor loss and yields the same rows.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.scalars import LCG_INCREMENT, LCG_MODULUS, LCG_MULTIPLIER


class _Block(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class RandomRowsReader(DataSourceReader):
    def __init__(self, n: int, parallelism: int, cols: int):
        self.n, self.parallelism, self.cols = n, parallelism, cols

    def partitions(self):
        size = max(1, self.n // self.parallelism)
        return [_Block(s, min(s + size, self.n)) for s in range(0, self.n, size)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa
        ids = np.arange(partition.start, partition.end, dtype=np.int64)
        arrays, names, v = [ids], ["row_id"], ids
        for j in range(self.cols):
            v = ((v % LCG_MODULUS) * LCG_MULTIPLIER + LCG_INCREMENT) % LCG_MODULUS
            arrays.append(v)
            names.append(f"c_{j}")
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


class RandomRowsSource(DataSource):
    @classmethod
    def name(cls):
        return "random_rows"

    def schema(self):
        cols = int(self.options.get("num_columns", 1))
        return "row_id long, " + ", ".join(f"c_{j} long" for j in range(cols))

    def reader(self, schema):
        return RandomRowsReader(int(self.options.get("n", 1000)), int(self.options.get("parallelism", 8)),
                                int(self.options.get("num_columns", 1)))


def register(spark) -> None:
    spark.dataSource.register(RandomRowsSource)
