"""Helpers shared by the training-data operators: session settings, ordered buckets,
whole-batch word hashing, files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, scratch_path, ship_package

#: White space of the word pattern [^\x20\x09-\x0D]+ as bytes; all of it is ASCII, so
#: words can be cut on UTF-8 bytes without decoding.
SPACES = b" \t\n\x0b\x0c\r"
#: The same pattern for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: the shared folder, this package on the workers,
    and Arrow batches small enough that a batch of very long texts fits a Python worker."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- ordered buckets ---------------------------------------------------------------

def bounds_of(df: DataFrame, col: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points of a long column (one column is read; nulls are
    ignored). The driver holds one number per bucket, and as literals they give the same
    bucket to a row however often a task runs again."""
    cuts = df.approxQuantile(col, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return sorted({int(c) for c in cuts if c == c})


def bucket_of(col: Column, cuts: list[int]) -> Column:
    """Number of cut points not above the value, by binary search; nulls go to bucket 0."""
    if not cuts:
        return F.lit(0)
    arr, n = F.lit(cuts).cast("array<bigint>"), len(cuts)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    return F.coalesce(F.aggregate(
        F.lit(steps), F.lit(0),
        lambda acc, s: F.when((acc + s <= n) & (F.get(arr, acc + s - 1) <= col), acc + s).otherwise(acc)), F.lit(0))


# -- rows with a number ------------------------------------------------------------

def numbered(docs: DataFrame) -> DataFrame:
    """``row``, a number of its own for every row, and ``doc``, the row's columns as a struct
    (whatever their names). The numbers change when it is evaluated again: write it first."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of the shared folder: one evaluation for all that read them."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- words of whole batches --------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, made: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if n > made.get("n", 0):
        m = max(n, _PIECE + 1)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        pows = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, b, np.uint64)]), dtype=np.uint64)
                for b in (_BASE, inv)]
        made.update(n=m, p=pows)
    return made["p"]


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in UTF-8 bytes."""
    gap = _IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hash of each word's bytes). Long buffers are hashed in pieces
    cut between words, so the temporaries stay near a megabyte times a small factor."""
    s, e = words(buf)
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + _PIECE, side="right")))
        lo, hi = int(s[i]), int(e[j - 1])
        p, q = _powers(hi - lo + 1)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=run[1:])
        out[i:j] = (run[e[i:j] - lo] - run[s[i:j] - lo]) * q[s[i:j] - lo]
        i = j
    return s, e, mix(out)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * _BASE + h[j: j + n]
    return mix(acc)


def chunks(texts: list[bytes], limit: int = _PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts of about ``limit`` bytes (a longer text is a run
    of its own): (first, last, bytes with a line feed after every text, text starts)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j]) + 1
            j += 1
        part = texts[i:j]
        buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        yield i, j, buf, starts
        i = j


def utf8(col: pa.Array) -> list[bytes]:
    """A string column as bytes; null is the empty text."""
    return [b or b"" for b in col.cast(pa.binary()).to_pylist()]


# -- files in the shared folder ----------------------------------------------------

def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (as a URI) under the shared folder."""
    path = scratch_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def open_fs(uri: str):
    """The pyarrow file system and path of a URI, as tasks use it."""
    from pyarrow import fs
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        uri = "file:///" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def attempt_name(stem: str) -> str:
    """A file name no other attempt of the same task uses: only names listed in a
    materialised manifest are ever read, so a lost or doubled attempt does no harm."""
    return f"{stem}-{uuid.uuid4().hex[:12]}"
