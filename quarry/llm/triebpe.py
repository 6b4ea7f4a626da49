"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a string by BPE has one property that makes prefixes reusable: if ``last[i]`` is
the last token of the encoding of the first i bytes, then last[i] is the one token t that ends
there and that either starts at 0 or may follow last[i - len(t)], where "may follow" means that
the merges of the two tokens, run together, would not join across their border. So a prefix's
state is the list of its last tokens, and every word with that prefix shares it.

New distinct words of a run of texts are put in a trie (held as the sorted list of words, whose
common prefixes are its inner paths) and walked depth first: going down adds one last token per
byte, going up drops them, and no byte of a shared prefix is computed twice. Following last
tokens back from a word's end gives its encoding.

Defined results: a null text is the empty text, with no token; special tokens written in a text
are encoded as the tokenizers library encodes them; repeated rows are all returned; an empty
table gives an empty result; whole texts are encoded, whatever their length. Only ``doc_id`` and
``text`` are read (``encode`` keeps doc_id and adds ids).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import ready
from quarry.llm.pieces import Encoder, text_runs

VOCABULARY = "byte_bpe_50k.json"
_PAIRS = 2_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes are themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """Tokens are numbered 0-255 for bytes, then 256 + merge rank; ``out`` maps to vocabulary
    ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        own = {c: b for c, b in letters.items()}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            own[left + right] = len(self.parts)
            self.parts.append((own[left], own[right]))
            self.bytes.append(self.bytes[own[left]] + self.bytes[own[right]])
        self.joined = {p: t for t, p in enumerate(self.parts) if p}
        self.out = [0] * len(self.parts)
        for name, t in own.items():
            self.out[t] = vocab[name]
        self.decoded = {self.out[t]: b for t, b in enumerate(self.bytes)}
        for token in spec["added_tokens"]:
            self.decoded[token["id"]] = token["content"].encode()
        # tokens by their bytes from the last to the first: nested tables, the token under -1
        self.ending: dict = {}
        for t, b in enumerate(self.bytes):
            at = self.ending
            for x in reversed(b):
                at = at.setdefault(x, {})
            at[-1] = t
        self.seen: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b can stand after a in an encoding: no merge of lower rank than the last one
        undone joins across the border, undoing the later of the two tokens' merges each time."""
        known = self.seen.get((a, b))
        if known is not None:
            return known
        left, right, limit, ok = a, b, len(self.parts), True
        while True:
            if self.joined.get((left, right), limit) < limit:
                ok = False
                break
            undo_left = left > right
            p = self.parts[left if undo_left else right]
            if p is None:  # both are bytes
                break
            if undo_left:
                limit, left = left, p[1]
            else:
                limit, right = right + 1, p[0]
        if len(self.seen) >= _PAIRS:
            self.seen.clear()
        self.seen[a, b] = ok
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of every word, by one depth-first walk over the trie of the words."""
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        out: list[list[int]] = [[]] * len(raw)
        last: list[int] = []  # last token at every depth of the current path
        path = b""
        ending, may, size, ids = self.ending, self.may_follow, self.bytes, self.out
        for w in order:
            word = raw[w]
            keep, most = 0, min(len(path), len(word))
            while keep < most and path[keep] == word[keep]:
                keep += 1
            del last[keep:]
            for i in range(keep, len(word)):
                at, j = ending, i
                while True:  # tokens that end at byte i, shortest first
                    at = at.get(word[j])
                    t = at.get(-1)
                    if t is not None and (j == 0 or may(last[j - 1], t)):
                        break
                    j -= 1
                last.append(t)
            path, i, got = word, len(word), []
            while i:
                t = last[i - 1]
                got.append(ids[t])
                i -= len(size[t])
            got.reverse()
            out[w] = got
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.decoded.__getitem__, ids))


_MADE: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per Python worker: its table serves all the tasks the worker runs."""
    if path not in _MADE:
        from tokenizers import Tokenizer
        bpe = TrieBPE(path)
        made = Encoder(Tokenizer.from_file(path), bpe.encode_words)
        made.bpe = bpe
        _MADE[path] = made
    return _MADE[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the token ids of the text."""
    ready(docs.sparkSession)
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in text_runs(texts):
                got = [enc.gather(s) for s in enc.slots(texts[i:j])]
                at = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
                flat = pa.array(np.concatenate([*got, np.empty(0, np.uint32)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[i:j], pa.ListArray.from_arrays(pa.array(at), flat)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def op8(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass; the digests are made where the ids are."""
    ready(docs.sparkSession)
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        told: list[str] = []  # ids of every slot as decimals
        back: list[bytes] = []  # and as decoded bytes
        generation = None
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in text_runs(texts):
                slots = enc.slots(texts[i:j])
                if generation != enc.generation:
                    generation = enc.generation
                    told.clear()
                    back.clear()
                for ids in enc.ids[len(told):]:
                    told.append(",".join(map(str, ids)))
                    back.append(enc.bpe.decode(ids))
                n, x, y = [], [], []
                for s in slots:
                    at = s.tolist()
                    n.append(int(enc.length[s].sum()))
                    x.append(sha256(",".join(map(told.__getitem__, at)).encode()).hexdigest())
                    text = b"".join(map(back.__getitem__, at)).decode("utf-8", "replace")
                    y.append(sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[i:j], pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
