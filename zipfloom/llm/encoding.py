"""Token ids of a public byte-level BPE, by batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round looks up all adjacent
pairs by binary search over sorted pair keys, takes each word's lowest rank,
merges it wherever the word has it, and drops the words that are done.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's file; a parameter of every function here.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids per worker; characters of text split at once.
KEPT_WORDS, CHARS_AT_ONCE = 200_000, 4_000_000
#: Symbols beyond which a single word is merged through a heap, in n log n.
LONG_WORD = 2_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's strings.

    Printable bytes stand for themselves; the others take the code points from
    256 on, in order.
    """
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Sorted pair keys with their ranks and results; arrays only, for broadcast."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.rank = np.arange(len(pairs), dtype=np.int64)[order]
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.bytes = np.array([vocab[c] for c in byte_letters()], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each pair and its rank, the latter _NONE where there is no merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.rank[at], _NONE)


def merge_words(m: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and each word's number of ids."""
    sizes = np.array([len(w) for w in words], np.int64)
    short = np.flatnonzero(sizes <= LONG_WORD)
    done_word, done_ids = [], []
    for k in np.flatnonzero(sizes > LONG_WORD):
        ids = _merge_long(m, words[k])
        done_word.append(np.full(len(ids), k))
        done_ids.append(ids)
    sym = m.bytes[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
    word = np.repeat(short, sizes[short])
    while len(sym):
        inside = np.r_[word[1:] == word[:-1], False]
        rank = np.full(len(sym), _NONE)
        at = np.zeros(len(sym), np.int64)
        i = np.flatnonzero(inside)
        at[i], rank[i] = m.find(sym[i], sym[i + 1])
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        spans = np.diff(np.r_[starts, len(sym)])
        least = np.repeat(np.minimum.reduceat(rank, starts), spans)
        over = least == _NONE
        if over.any():
            done_word.append(word[over])
            done_ids.append(sym[over])
            keep = ~over
            sym, word, rank, least, at = sym[keep], word[keep], rank[keep], least[keep], at[keep]
        hit = rank == least
        run = np.flatnonzero(hit)
        if not len(run):
            continue
        # of overlapping hits (a pair of equal symbols) every second one merges, from the left
        head = np.r_[True, np.diff(run) != 1]
        first = run[head]
        place = run - np.repeat(first, np.diff(np.r_[np.flatnonzero(head), len(run)]))
        run = run[place % 2 == 0]
        sym[run] = m.result[at[run]]
        keep = np.ones(len(sym), bool)
        keep[run + 1] = False
        sym, word = sym[keep], word[keep]
    ids = np.concatenate([np.empty(0, np.int64), *done_ids])
    owner = np.concatenate([np.empty(0, np.int64), *done_word])
    order = np.argsort(owner, kind="stable")
    return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))


def _merge_long(m: Merges, word: bytes) -> np.ndarray:
    """The same merges for one very long word: a heap of pairs over a linked list."""
    sym = m.bytes[np.frombuffer(word, np.uint8)]
    n = len(sym)
    at, rank = m.find(sym[:-1], sym[1:])
    ids, nxt, prv, gone = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(int(rank[i]), int(i), ids[i], ids[i + 1], int(at[i])) for i in np.flatnonzero(rank != _NONE)]
    heapq.heapify(heap)
    keys, ranks, base = m.keys, m.rank, int(m.base)

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n:
            k = int(np.searchsorted(keys, ids[i] * base + ids[j]))
            if k < len(keys) and keys[k] == ids[i] * base + ids[j]:
                heapq.heappush(heap, (int(ranks[k]), i, ids[i], ids[j], k))

    while heap:
        _, i, a, b, k = heapq.heappop(heap)
        j = nxt[i]
        if gone[i] or ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i] = int(m.result[k])
        gone[j] = True
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return np.array([x for x, g in zip(ids, gone) if not g], np.int64)


class Encoder:
    """Encodes texts; keeps the ids of words that it has met."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.split = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, sizes = merge_words(self.m, [w.encode("utf-8", "surrogatepass") for w in words])
        start = len(self.flat) + np.cumsum(sizes) - sizes
        self.index.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.flat = np.concatenate([self.flat, ids])
        self.start = np.concatenate([self.start, start])
        self.size = np.concatenate([self.size, sizes])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's number of ids."""
        flats, counts, lo = [], [], 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= CHARS_AT_ONCE):
                chars += len(texts[hi] or "")
                hi += 1
            flat, count = self._encode(texts[lo:hi])
            flats.append(flat)
            counts.append(count)
            lo = hi
        return np.concatenate([np.empty(0, np.int32), *flats]), np.concatenate([np.empty(0, np.int64), *counts])

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split(t) if t else [] for t in texts]
        words = [w for s in split for w in s]
        if len(self.index) > KEPT_WORDS:
            self._reset()
        fresh = list({w for w in words if w not in self.index})
        if fresh:
            self._learn(fresh)
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.size[which]
        total = int(sizes.sum())
        at = np.repeat(self.start[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        of_text = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        count = np.bincount(of_text, weights=sizes, minlength=len(texts)).astype(np.int64)
        return self.flat[at], count


def _encoder_map(shared, lengths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            flat, count = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
            names = list(batch.schema.names[:-1])
            if lengths:
                last = pa.array(count, pa.int64())
            else:
                ends = np.r_[0, np.cumsum(count)].astype(np.int32)
                last = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=[*names, "out"])

    return run


def _encoded(df: DataFrame, keep: list[str], text: str, out: str, vocabulary: str, lengths: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Merges(vocabulary))  # as large as the vocabulary, whatever the data
    src = df.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    got = src.mapInArrow(_encoder_map(shared, lengths), f"{kept}, out {'bigint' if lengths else 'array<int>'}")
    return got.withColumnRenamed("out", out)


def encode_texts(
    df: DataFrame, keep: list[str], text: str = "text", out: str = "ids", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """The columns ``keep`` and ``out``, the token ids of ``text``.

    No special tokens are added and none are recognised.  A null and an empty
    text have no ids (an empty list).  One row per row, repeated ones included;
    any length of text; other columns are left out, whatever their names.  A
    narrow map: nothing is shuffled.
    """
    return _encoded(df, keep, text, out, vocabulary, False)


def count_tokens(
    df: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """As :func:`encode_texts`, with the number of ids only."""
    return _encoded(df, keep, text, out, vocabulary, True)
