"""Document fingerprints by one-permutation MinHash.

Every 5-word shingle is hashed once; the hash's top bits choose one of 256 bins and each bin
keeps its minimum. Empty bins are filled by optimal densification: bin i probes bins given by
a fixed hash of (i, attempt) until it meets one that was not empty, and takes its minimum. The
low 8 bits of every bin are stored (256 bytes). Equal stored bytes of two different minima are
expected in 1 of 256 bins, and the likeness estimate is corrected for that.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined results: a text of fewer than five words
has one shingle, the whole sequence; a text without a word (null and empty too) has the empty
fingerprint, alike (1.0) only to another empty one. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounds_of, bucket_of, chunks, mix, partitions, ready, utf8, window_hashes, word_hashes

SHINGLE, BINS, BITS = 5, 256, 8
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def _densify(m: np.ndarray) -> None:
    """Fill the empty bins of every row that has a full one."""
    full = m != _EMPTY
    doc, bin_ = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(doc):
        attempt += 1
        probe = (mix(bin_.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt * 0x9E3779B97F4A7C15 % (1 << 64)))
                 >> _SHIFT).astype(np.int64)
        hit = full[doc, probe]
        m[doc[hit], bin_[hit]] = m[doc[hit], probe[hit]]
        doc, bin_ = doc[~hit], bin_[~hit]


def fingerprints(texts: list[bytes]) -> list[bytes]:
    """The packed fingerprint of every text (b"" without a word)."""
    out: list[bytes] = []
    for i, j, buf, at in chunks(texts):
        s, _, h = word_hashes(buf)
        first = np.searchsorted(s, at)  # word range of every text
        n = np.diff(first)
        grams = window_hashes(h, SHINGLE)
        owner = np.repeat(np.arange(j - i), n)[: len(grams)]
        inside = np.arange(len(grams)) + SHINGLE <= first[owner + 1]
        grams, owner = grams[inside], owner[inside]
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        whole = np.array([window_hashes(h[first[d]: first[d + 1]], int(n[d]))[0] for d in short], np.uint64)
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
        m = np.full((j - i, BINS), _EMPTY)
        np.minimum.at(m.reshape(-1), owner * BINS + (grams >> _SHIFT).astype(np.int64), mix(grams))
        _densify(m)
        low = (m & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        out += [low[d].tobytes() if n[d] else b"" for d in range(j - i)]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets, corrected for chance agreement of
    the stored bits, in [0, 1]."""
    if not a or not b:
        return float(a == b)
    chance = 1 / (1 << BITS)
    same = np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint in hexadecimal; no shuffle."""
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([f.hex() for f in fingerprints(utf8(b.column("text")))], pa.string())],
                ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(b, extra, doc_id, text) in partitions ordered by descending doc_id, one run per bucket
    b, each ending with an ``extra`` copy of the document that follows the bucket's last one
    (after the smallest doc_id: the largest). Null doc_ids come after all others.

    Bucket limits are literals; the one row per bucket that is copied is found from the
    bucket's smallest and largest doc_id, so text is shuffled once."""
    spark = docs.sparkSession
    n = partitions(spark)
    low = -(1 << 63)
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"), "text")
    cuts = bounds_of(d.select("doc_id"), "doc_id", n)
    ends = d.groupBy(bucket_of(F.col("k"), cuts).alias("b")).agg(F.max("k").alias("top")).orderBy("b").collect()  # <= n rows
    follow = [(ends[i - 1]["top"], ends[i]["b"]) for i in range(len(ends))]  # i = 0 wraps to the largest
    copies = spark.createDataFrame(follow, "k bigint, to int").groupBy("k").agg(F.collect_list("to").alias("to"))
    own = F.array(F.struct(bucket_of(F.col("k"), cuts).cast("int").alias("b"), F.lit(False).alias("extra")))
    more = F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda t: F.struct(t.alias("b"), F.lit(True).alias("extra")))
    return d.join(F.broadcast(copies), "k", "left").select("doc_id", "k", "text", F.explode(F.concat(own, more)).alias("x")) \
        .select("x.b", "x.extra", "doc_id", "k", "text") \
        .repartitionById(n, F.col("b")).sortWithinPartitions("b", "extra", F.desc("k"), "text")


def op1(docs: DataFrame) -> DataFrame:
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: bucket, id, text, fingerprint
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            prints = fingerprints([t.encode() for t in texts])
            rows = list(zip(batch.column("b").to_pylist(), batch.column("extra").to_pylist(),
                            batch.column("doc_id").to_pylist(), texts, prints))
            done, edited = [], []
            for row in rows:
                if held is not None and held[0] == row[0] and not held[1]:
                    cut = len(held[3]) // 2
                    done.append((held, row))
                    edited.append((held[3][: len(held[3]) - cut] + row[3][:cut]).encode())
                held = row
            new = fingerprints(edited)
            yield pa.RecordBatch.from_pylist([{
                "doc_id": a[2], "n_chars": len(a[3]), "edited_sha256": sha256(e).hexdigest(), "fingerprint": a[4].hex(),
                "edited_fingerprint": f.hex(), "near_edited": likeness(a[4], f), "near_next": likeness(a[4], b[4]),
            } for (a, b), e, f in zip(done, edited, new)], schema=made)

    made = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.int32()), ("n_chars", pa.int64()),
                      ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                      ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return with_next(docs).mapInArrow(run, schema)
