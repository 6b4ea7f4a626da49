"""Token-id files with a shared zstandard dictionary.

A dataset is a folder: one file per task with every document's ids as a zstandard frame of its
own, the dictionary that all frames share, and an offset index (a Parquet table). A file starts
with a header that holds the bytes of an id and the dictionary's SHA-256, which readers compare
before they decode. A short document is read by one seek and one small frame.

The dictionary is trained on a bounded, documented sample: the id arrays of the ``SAMPLE``
documents with the smallest hash of the id, in pieces of at most ``PIECE`` bytes and at most
``PIECES`` of them. It affects sizes only, never contents.

Documents are in ascending doc_id order (a null id first; equal ids by text) over the files in
part order, from literal bucket limits, so a task that runs again writes the same documents.
Files have names of their own for every attempt, and only those in the index are read.

Defined results: a null text is the empty text, whose only id is the end id; repeated rows are
separate documents; an empty table gives an empty dataset and result; whole texts are encoded.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import attempt_name, bounds_of, bucket_of, open_fs, partitions, ready, shared_folder
from quarry.llm.pieces import Encoder, text_runs

END_ID = 0
MAGIC, HEADER = b"QIDS0001", "<8sI32s"
DICTIONARY_BYTES, LEVEL = 1 << 16, 1
SAMPLE, PIECE, PIECES = 256, 1 << 14, 2048
_INDEX = "part int, path string, seq bigint, doc_id {kind}, offset bigint, length bigint, local bigint, n_tokens bigint"

_MADE: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The tokenizers library behind a table of distinct pieces; one per Python worker."""
    if path not in _MADE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(path)
        made = Encoder(library, lambda words: [e.ids for e in library.encode_batch(words, add_special_tokens=False)])
        made.width = 2 if library.get_vocab_size() <= 1 << 16 else 4
        _MADE[path] = made
    return _MADE[path]


def _encoded(enc: Encoder, texts: list[str]) -> Iterator[bytes]:
    """The serialized id array of every text, with the end id."""
    kind = "<u2" if enc.width == 2 else "<u4"
    for i, j in text_runs(texts):
        for s in enc.slots(texts[i:j]):
            yield np.append(enc.gather(s), np.uint32(END_ID)).astype(kind).tobytes()


def train(docs: DataFrame, vocabulary: str) -> bytes:
    """The shared dictionary (empty when there is nothing to train on)."""
    ids = [r[0] for r in docs.select("doc_id").filter("doc_id is not null")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for b in batches:
            parts = [x[k: k + PIECE] for x in _encoded(enc, [t or "" for t in b.column("text").to_pylist()])
                     for k in range(0, len(x), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["part"])

    got = docs.filter(F.col("doc_id").isin(ids)).select("text").mapInArrow(run, "part binary").limit(PIECES).collect() if ids else []
    parts = sorted(bytes(r[0]) for r in got)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b"".join(parts)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, folder: str, vocabulary: str) -> None:
    """Write the dataset: files, dictionary and index."""
    spark = ready(docs.sparkSession)
    dictionary = train(docs, vocabulary)
    key = sha256(dictionary).digest()
    fsys, base = open_fs(folder)
    fsys.create_dir(base, recursive=True)
    with fsys.open_output_stream(f"{base}/{key.hex()}.dict", compression=None) as out:
        out.write(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    n, kind = partitions(spark), docs.schema["doc_id"].dataType.simpleString()
    part = bucket_of(F.col("doc_id").cast("long"), bounds_of(docs.select("doc_id"), "doc_id", n))
    placed = docs.select(part.cast("int").alias("part"), "doc_id", "text").repartitionById(n, F.col("part")) \
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = _encoder(vocabulary), None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(sent.value))
        at = local = seq = 0
        try:
            for b in batches:
                if out is None:
                    fs_, at_ = open_fs(folder)
                    name = attempt_name("ids") + ".bin"
                    out = fs_.open_output_stream(f"{at_}/{name}", compression=None)
                    out.write(struct.pack(HEADER, MAGIC, enc.width, key))
                    at = struct.calcsize(HEADER)
                offset, length, start, count = [], [], [], []
                for raw in _encoded(enc, [t or "" for t in b.column("text").to_pylist()]):
                    frame = press.compress(raw)
                    out.write(frame)
                    offset.append(at)
                    length.append(len(frame))
                    start.append(local)
                    count.append(len(raw) // enc.width)
                    at, local = at + len(frame), local + count[-1]
                rows = len(offset)
                yield pa.RecordBatch.from_arrays(
                    [b.column("part"), pa.array([f"{folder}/{name}"] * rows), pa.array(range(seq, seq + rows), pa.int64()), b.column("doc_id"),
                     pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64())],
                    ["part", "path", "seq", "doc_id", "offset", "length", "local", "n_tokens"])
                seq += rows
        finally:
            if out is not None:
                out.close()

    placed.mapInArrow(run, _INDEX.format(kind=kind)).write.mode("overwrite").parquet(f"{folder}/index")


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    index = spark.read.parquet(f"{folder}/index")
    kind = index.schema["doc_id"].dataType.simpleString()
    # one row per part; a task may hold parts of one file only, so this is at most the number of tasks
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("size").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, path, keys, crc, count = None, None, {}, None, None
        for b in batches:
            crc, count = [], []
            for p, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if p != path:
                    fs_, at_ = open_fs(p)
                    opened, path = fs_.open_input_file(at_), p
                    magic, width, key = struct.unpack(HEADER, opened.read(struct.calcsize(HEADER)))
                    if key not in keys:
                        with fs_.open_input_stream(f"{at_.rpartition('/')[0]}/{key.hex()}.dict", compression=None) as f:
                            data = f.read()
                        if magic != MAGIC or sha256(data).digest() != key:
                            raise ValueError(f"{p} was not written with the dictionary beside it")
                        keys[key] = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
                    unpress, kind_ = keys[key], "<u2" if width == 2 else "<u4"
                opened.seek(offset)
                ids = np.frombuffer(unpress.decompress(opened.read(length)), kind_).astype("<u4")
                crc.append(zlib.crc32(ids.tobytes()))
                count.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("doc_id"), b.column("local"), pa.array(count, pa.int64()), pa.array(crc, pa.int64())],
                ["part", "doc_id", "local", "n_tokens", "ids_crc32"])

    got = index.select("part", "path", "doc_id", "offset", "length", "local").mapInArrow(
        run, f"part int, doc_id {kind}, local bigint, n_tokens bigint, ids_crc32 bigint")
    return got.join(F.broadcast(before), got["part"] == before["_part"]).select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op7(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    from quarry.llm.triebpe import vocabulary_path
    spark = ready(docs.sparkSession)
    folder = shared_folder(spark, "token-ids")
    write(docs, folder, vocabulary or vocabulary_path())
    return read(spark, folder)
