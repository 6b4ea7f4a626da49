"""The byte-level tokenizer's pre-token cut, for whole batches at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its cuts follow from the classes (letter, number, space, other) of neighbouring characters, so
they are found with array operations on the batch's code points. Texts with characters outside
the ranges below are cut by the tokenizer library itself, so that newer Unicode characters are
classed as it classes them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from quarry.llm.common import mix

LETTER, NUMBER, OTHER, SPACE = range(4)
_LIMIT = 0x2028
_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Class of every code point below the limit; 9 = leave the text to the library."""
    if not _TABLE:
        import regex
        t = np.full(_LIMIT + 1, 9, np.uint8)
        for cp in [*range(0x250), *range(0x2010, _LIMIT)]:
            c = chr(cp)
            t[cp] = SPACE if regex.match(r"\s", c) else LETTER if regex.match(r"\p{L}", c) else \
                NUMBER if regex.match(r"\p{N}", c) else OTHER
        t[0x85] = t[0x1C:0x20] = 9  # white space in one library, not in another
        _TABLE.append(t)
    return _TABLE[0]


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts joined, their code points, piece starts, first piece of every text and one past
    the last, indexes of texts with unusual characters, whose pieces are not to be used)."""
    joined = "".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(cps)
    if n == 0:
        return joined, cps, np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64)
    cls = np.concatenate([_table().take(cps, mode="clip"), [OTHER]])  # one past the end
    first = np.zeros(n + 4, bool)  # starts of texts
    first[at] = True
    begin = np.zeros(n + 4, bool)
    begin[1:n] = cls[1:n] != cls[: n - 1]
    begin |= first
    # white space before another class: its last character stands alone, or joins if a blank
    e = np.flatnonzero((cls[: n - 1] == SPACE) & (cls[1:n] != SPACE)) + 1
    e = e[~first[e]]
    begin[e - 1] = True
    begin[e[cps[e - 1] == 0x20]] = False
    # contractions
    q = np.flatnonzero(cps == 0x27)
    q = q[begin[q] & (cls[q + 1] == LETTER) & ~first[q + 1]]
    if len(q):
        pad = np.concatenate([cps, np.zeros(3, np.uint32)])
        x, y = pad[q + 1], np.where(first[q + 2], 0, pad[q + 2])
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        for part, width in ((q[np.isin(x, [ord(c) for c in "stmd"])], 2), (q[two], 3)):
            begin[part + 1] = False
            after = part + width
            begin[after[(after < n)]] = True
    s = np.flatnonzero(begin[:n])
    odd = np.unique(np.searchsorted(at, np.flatnonzero(cls[:n] == 9), side="right") - 1)
    return joined, cps, s, np.searchsorted(s, at), odd


def text_runs(texts: list[str], limit: int = 1 << 20):
    """Runs of whole texts of about ``limit`` characters: (first, last)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONG = 256  # longer pieces are compared as strings, not by hash


class Encoder:
    """Texts to token ids through the distinct pieces of each run of texts.

    Pieces are told apart by 64-bit hashes of their code points; pieces not met before go to
    ``encode`` as one list. What a piece encodes to is kept in arrays, up to ``limit`` pieces,
    after which the table starts anew: memory is bounded and results do not change."""

    def __init__(self, library, encode: Callable[[list[str]], list[list[int]]], limit: int = 400_000):
        self.library, self.encode, self.limit = library, encode, limit
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self._pow = np.ones(1, np.uint64)
        self._inv = np.ones(1, np.uint64)
        self.generation = 0
        self.reset()

    def reset(self) -> None:
        self.generation += 1
        self.slot: dict = {}
        self.ids: list[list[int]] = []
        self.length = np.zeros(1 << 12, np.int64)
        self.start = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _powers(self, n: int) -> None:
        if n > len(self._pow):
            m = max(n, 1 << 20)
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self._pow, self._inv = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, b, np.uint64)]), dtype=np.uint64)
                                    for b in (_BASE, inv))

    def add(self, keys: list, pieces: list[str], ids: list[list[int]] | None = None) -> None:
        """Encode new pieces and give them slots."""
        ids = self.encode(pieces) if ids is None else ids
        have, n = len(self.ids), len(keys)
        self.slot.update(zip(keys, range(have, have + n)))
        self.ids += ids
        size = np.fromiter(map(len, ids), np.int64, n)
        total = int(size.sum())
        while have + n > len(self.length):
            self.length, self.start = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.length, self.start))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.length[have: have + n] = size
        self.start[have: have + n] = self.used + np.cumsum(size) - size
        self.flat[self.used: self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.used += total

    def _by_string(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in dict.fromkeys(pieces) if p not in self.slot]
        if new:
            self.add(new, new)
        return np.fromiter((self.slot[p] for p in pieces), np.int64, len(pieces))

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined, cps, s, first, odd = cut(texts)
        n = len(cps)
        if n == 0:
            slots = np.empty(0, np.int64)
        else:
            self._powers(n + 1)
            run = np.zeros(n + 1, np.uint64)
            np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * self._pow[:n], out=run[1:])
            e = np.append(s[1:], n)
            h = mix((run[e] - run[s]) * self._inv[s])
            codes, distinct = pd.factorize(h)
            keys = distinct.tolist()
            get = self.slot.get
            at = [get(k, -1) for k in keys]
            new = [i for i, x in enumerate(at) if x < 0]
            if new:
                where = np.zeros(len(keys), np.int64)
                where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                pos = where[new]
                a, b = s[pos].tolist(), e[pos].tolist()
                have = len(self.ids)
                self.add([keys[i] for i in new], [joined[x:y] for x, y in zip(a, b)])
                for k, i in enumerate(new):
                    at[i] = have + k
            slots = np.asarray(at, np.int64)[codes]
            long = np.flatnonzero(e - s > _LONG)
            if len(long):
                slots[long] = self._by_string([joined[x:y] for x, y in zip(s[long].tolist(), e[long].tolist())])
        out = [slots[first[i]: first[i + 1]] for i in range(len(texts))]
        for i in odd.tolist():
            out[i] = self._by_string([texts[i][a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(texts[i])])
        return out

    def slots(self, texts: list[str]) -> list[np.ndarray]:
        """The slots of every text's pieces. Special tokens written in a text are tokens, as
        the library takes them."""
        if len(self.ids) > self.limit:
            self.reset()
        marks = [m for m in self.special if any(m in t for t in texts)]
        if not marks:
            return self._plain(texts)
        for m in marks:
            if m not in self.slot:
                self.add([m], [m], [[self.special[m]]])
        parts, plan = [], []
        for t in texts:
            own: list = [t]
            for m in marks:
                own = [y for x in own for y in (_between(x, m) if isinstance(x, str) else [x])]
            plan.append([(len(parts) + i if isinstance(x, str) else x) for i, x in enumerate(own)])
            parts += [x if isinstance(x, str) else "" for x in own]
        got = self._plain(parts)
        return [np.concatenate([got[x] if isinstance(x, int) else np.array([self.slot[x[0]]], np.int64) for x in p]) for p in plan]

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """Token ids of a sequence of pieces."""
        size = self.length[slots]
        end = np.cumsum(size)
        if len(end) == 0:
            return np.empty(0, np.uint32)
        return self.flat[np.repeat(self.start[slots] - end + size, size) + np.arange(end[-1])]


def _between(text: str, mark: str) -> list:
    """The text cut at every mark, the marks between as one-tuples."""
    out: list = []
    for i, x in enumerate(text.split(mark)):
        out += [(mark,), x] if i else [x]
    return out
