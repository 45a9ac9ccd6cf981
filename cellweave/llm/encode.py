"""Token ids of whole texts by a byte-level BPE vocabulary given as ranks.

Words are cut by the vocabulary's public pattern. A word's merges are found with a segment tree over its byte
positions: each leaf holds the rank of the pair that starts there (and the position, so the minimum is the leftmost
of the lowest rank), the root tells the next merge, and a merge updates the leaves of the live neighbours, each in
logarithmic time. Trees of many words are worked off side by side as rows of one array; a word longer than
``LONG`` bytes gets a tree of its own, so that a text of one endless word costs n log n too.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG, NONE, SHIFT = 256, np.int64(1) << 62, 24
#: Words kept per worker and characters encoded at once: both bound memory, neither changes a result.
KEEP, CHUNK = 600_000, 1_000_000


#: A stretch of blanks and what follows it up to the next one: no word of the pattern reaches over its end, so stretches
#: are cut, known and looked up as wholes. Texts with other white space are cut by the pattern alone.
STRETCH = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+").findall
OTHER_SPACE = re.compile(r"[^\S \n\r\t]").search


class Table:
    """Ids of strings, one after the other in one array."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, names: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def get(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of lists of strings, all of them known."""
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        n = self.length[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else np.zeros(0, np.int32)
        return ends[np.concatenate([[0], np.cumsum([len(s) for s in split], dtype=np.int64)])], ids


class Encoder:
    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
        self.ids = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.width = 1 << max(ranks.values()).bit_length()
        pairs = {ranks[t[:i]] * self.width + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.find = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.words, self.stretches = Table(), Table()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (= id of the result) of pairs, -1 where they don't merge."""
        k = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[at] == k) & (a >= 0) & (b >= 0), self.values[at], -1)

    def long(self, word: bytes) -> list[int]:
        """One word, one tree."""
        n, w, pairs = len(word), self.width, self.pairs
        tok = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(n - 1, 1).bit_length()
        none = int(NONE)
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := pairs.get(tok[i] * w + tok[i + 1])) is not None:
                tree[size + i] = r << 40 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, v: int) -> None:
            i += size
            tree[i] = v
            while i > 1:
                i >>= 1
                v = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == v:
                    break
                tree[i] = v

        while (top := tree[1]) < none:
            i = top & (1 << 40) - 1
            j = after[i]
            tok[i], tok[j] = top >> 40, -1
            k = after[i] = after[j]
            put(j, none)
            if k < n:
                before[k] = i
            r = pairs.get(tok[i] * w + tok[k]) if k < n else None
            put(i, none if r is None else r << 40 | i)
            if (h := before[i]) >= 0:
                r = pairs.get(tok[h] * w + tok[i])
                put(h, none if r is None else r << 40 | h)
        return [t for t in tok if t >= 0]

    def rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many words of similar length: (lengths, ids one after the other)."""
        lens = np.array([len(w) for w in words])
        n, width = len(words), max(2, 1 << int(lens.max() - 1).bit_length())
        raw = np.zeros((n, width), np.uint8)
        mask = np.arange(width)[None, :] < lens[:, None]
        raw[mask] = np.frombuffer(b"".join(words), np.uint8)
        tok = np.where(mask, self.byte[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        r = self.rank(tok[:, :-1], tok[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(r >= 0, r << SHIFT | np.arange(width - 1)[None, :], NONE)
        for lo in _levels(width):
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def put(row: np.ndarray, i: np.ndarray, v: np.ndarray) -> None:
            i = i + width
            tree[row, i] = v
            for _ in range(width.bit_length() - 1):
                i = i >> 1
                tree[row, i] = np.minimum(tree[row, 2 * i], tree[row, 2 * i + 1])

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            top = tree[live, 1]
            i = top & (1 << SHIFT) - 1
            j = after[live, i]
            tok[live, i], tok[live, j] = top >> SHIFT, -1
            k = after[live, j]
            after[live, i] = k
            inside = k < width
            before[live[inside], k[inside]] = i[inside]
            put(live, j, np.full(len(live), NONE))
            r = self.rank(tok[live, i], np.where(inside, tok[live, np.minimum(k, width - 1)], -1))
            put(live, i, np.where(r >= 0, r << SHIFT | i, NONE))
            h = before[live, i]
            has = h >= 0
            row, h = live[has], h[has]
            r = self.rank(tok[row, h], tok[row, i[has]])
            put(row, h, np.where(r >= 0, r << SHIFT | h, NONE))
            live = live[tree[live, 1] < NONE]
        keep = tok >= 0
        return keep.sum(1), tok[keep]

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([max(1, len(x) - 1).bit_length() for x in data])
        order = np.argsort(size, kind="stable")
        lens, flats, names = [], [], []
        for s in np.unique(size).tolist():
            some = order[size[order] == s]
            if 1 << s > LONG:
                for x in some.tolist():
                    ids = self.long(data[x])
                    names.append(words[x])
                    lens.append(np.array([len(ids)]))
                    flats.append(np.array(ids))
                continue
            step = max(1, 400_000 >> s)
            for x in range(0, len(some), step):
                part = some[x : x + step].tolist()
                a, b = self.rows([data[i] for i in part])
                names += [words[i] for i in part]
                lens.append(a)
                flats.append(b)
        if names:
            self.words.add(names, np.concatenate(lens), np.concatenate(flats))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]; NULL and '' have none."""
        if len(self.words.known) + len(self.stretches.known) > KEEP:
            self.forget()
        split = [[] if not t else self.find(t) if OTHER_SPACE(t) else STRETCH(t) for t in texts]
        if new := list(set(chain.from_iterable(split)).difference(self.stretches.known)):
            cut = [self.find(s) for s in new]
            if words := set(chain.from_iterable(cut)).difference(self.words.known):
                self.learn(list(words))
            off, ids = self.words.get(cut)
            self.stretches.add(new, np.diff(off), ids)
        return self.stretches.get(split)


def _levels(width: int) -> Iterable[int]:
    while width > 1:
        width >>= 1
        yield width


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row, without special tokens and without shuffle; NULL and empty texts have the empty list.

    ``vocabulary`` is a file of ranks on the driver; it is shipped to the executors.
    """
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(SparkFiles.get(name))
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at, rows = 0, b.num_rows
            while at < rows:
                to, chars, part = at, 0, []
                while to < rows and (not part or chars < CHUNK):
                    part.append(texts[to].as_py())
                    chars += len(part[-1] or "")
                    to += 1
                off, flat = e.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), lists], ["id", "ids"])
                at = to

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
