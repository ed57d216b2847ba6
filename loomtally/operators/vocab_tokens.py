"""Token counts with a vocabulary: byte-level BPE and SentencePiece-style segmentation, in Arrow UDFs with a broadcast vocabulary.

Defined deviations: BPE merges as the textbook says (an absorbed symbol can't merge again), a space is marked by U+2581, and the byte
alphabet of a tokenizer.json is decoded. Neither engine pre-tokenizes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SPACE = b"\xe2\x96\x81"
LONGEST_WORD = 2048
BREAKS = b"\t\n\r\x0b\x0c"
_BROKEN = bytes(10 if b in BREAKS else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Scores that one block of words holds at most.
BLOCK_CELLS = 1 << 20


def bpe_count(data: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of the whole byte string: the pair of lowest rank merges first, the leftmost among equals. A heap and links: n log n. For
    vocabularies whose ranks do not rise; PairRanks counts with all others."""
    n = len(data)
    if n < 2:
        return n
    end, nxt, prv, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), n
    gone = bytearray(n)
    heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        end[i], nxt[i], gone[j] = stop, nxt[j], 1
        alive -= 1
        k = nxt[i]
        if k < n:
            prv[k] = i
            if (r := ranks.get(data[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = prv[i]
        if h >= 0 and (r := ranks.get(data[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return alive


class PairRanks:
    """The pairs that a vocabulary of ranks merges. `rising`: whether every token has a higher rank than what it can be merged from. Ranks applied
    in ascending order, each at all its places at once, then give what one merge after another gives."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.ids = {token: i for i, token in enumerate(ranks)}
        self.size = len(ranks) + 256
        self.first = np.array([self.ids.get(bytes([b]), len(ranks) + b) for b in range(256)], np.int64)
        level = lambda t: ranks[t] if len(t) > 1 else -1
        known = lambda t: len(t) == 1 or t in ranks
        code = lambda t: self.ids[t] if t in self.ids else len(ranks) + t[0]
        pairs, self.rising = [], len(set(ranks.values())) == len(ranks)
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = token[:cut], token[cut:]
                if known(a) and known(b):
                    pairs.append((code(a) * self.size + code(b), rank, self.ids[token]))
                    self.rising &= rank > level(a) and rank > level(b)
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.key_ranks = np.array([p[1] for p in pairs], np.int64)
        self.made = {p[1]: p[2] for p in pairs}

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the pairs; -1 where none merges."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int64)
        key = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], -1)

    def count_all(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text, for all texts together."""
        if not self.rising:
            return np.array([bpe_count(t, self.ranks) for t in texts], np.int64)
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        sym = self.first[data]
        sym[ends] = -1
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.look_up(sym[:-1], sym[1:])
        # The index: the places of each rank, in lists of arrays that are joined when its turn comes.
        places: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> None:
            at = at[pair[at] >= 0]
            if not len(at):
                return
            order = np.argsort(pair[at], kind="stable")
            at, r = at[order], pair[at][order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for rank, part in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(due, rank)
                places[rank].append(part)

        due: list[int] = []
        enter(np.arange(n))
        while due:
            rank = heapq.heappop(due)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            # Of pairs that share a token the first, third, ... of each run merge.
            joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
            runs = np.arange(len(at)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[runs % 2 == 0]
            gone = after[at]
            far = after[gone]
            sym[at] = self.made[rank]
            sym[gone], pair[gone] = -2, -1
            after[at] = far
            inside = far < n
            before[far[inside]] = at[inside]
            left = before[at]
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            right = after[touched]
            pair[touched] = self.look_up(sym[touched], np.where(right < n, sym[np.minimum(right, n - 1)], -1))
            enter(touched)
        alive = np.concatenate(([0], np.cumsum(sym >= 0)))
        return alive[ends] - alive[ends - sizes]


class Pieces:
    """A SentencePiece vocabulary: scores of normal pieces (type 1), byte pieces (6) and the unknown score (2)."""

    def __init__(self, rows: list[tuple[bytes, float, int]]) -> None:
        normal: dict[bytes, float] = {}
        self.single = np.full(256, next((s for _, s, kind in reversed(rows) if kind == 2), -np.inf))
        for piece, score, kind in rows:
            if kind == 1:
                normal.setdefault(bytes(piece), score)
            elif kind == 6 and (m := re.fullmatch(rb"<0x([0-9A-Fa-f]{1,2})>", bytes(piece))):
                self.single[int(m[1], 16)] = score
        self.longest = max(map(len, normal), default=1)
        # Pieces by length: sorted 64-bit hashes and their scores.
        self.tables = []
        for size in range(1, self.longest + 1):
            own = [p for p in normal if len(p) == size]
            keys = np.zeros(len(own), np.uint64)
            for k in range(size):
                keys = keys * _STEP + np.array([p[k] + 1 for p in own], np.uint64)
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array([normal[p] for p in own], np.float64)[order]))

    def segment(self, words: list[bytes]) -> np.ndarray:
        """Pieces of the best-scoring segmentation of each word; of equal scores the one whose last piece is longest stays, and a piece before a
        byte. All words of a block go forward together, a byte at a time; all lengths of the last piece are tried at once."""
        width, longest = max(map(len, words)), self.longest
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.uint64)
        # gain[:, j, longest - L]: the score of the piece of length L that ends after byte j.
        gain = np.full((len(words), width, longest), -np.inf)
        keys = np.zeros((len(words), width), np.uint64)
        for length, (known, scores) in enumerate(self.tables, 1):
            if length > width:
                break
            keys = keys[:, : width - length + 1] * _STEP + data[:, length - 1 :] + np.uint64(1)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                gain[:, length - 1 :, longest - length] = np.where(known[at] == keys, scores[at], -np.inf)
        best = np.full((len(words), width + longest), -np.inf)
        count = np.zeros((len(words), width + longest), np.int64)
        best[:, longest - 1] = 0.0
        row = np.arange(len(words))
        byte = self.single[data.astype(np.int64)]
        for j in range(width):
            ways = best[:, j : j + longest] + gain[:, j]
            pick = ways.argmax(axis=1)  # the first of equal ones, hence the longest piece
            top, steps = ways[row, pick], count[row, j + pick] + 1
            alone = best[:, j + longest - 1] + byte[:, j]
            last = alone > top
            best[:, j + longest] = np.where(last, alone, top)
            count[:, j + longest] = np.where(last, count[:, j + longest - 1] + 1, steps)
        end = size + longest - 1
        return np.where(best[row, end] > -np.inf, count[row, end], -(-size // 4))

    def count_all(self, texts: list[bytes]) -> np.ndarray:
        """Pieces of each text. Segments lie between line breaks and tabs, in stretches of LONGEST_WORD bytes; a space is a mark of its word."""
        words: dict[bytes, int] = {}
        owner, which = [], []
        for i, text in enumerate(texts):
            for part in text.translate(_BROKEN).split(b"\n"):
                marked = part.replace(b" ", SPACE)
                for k in range(0, len(marked), LONGEST_WORD):
                    owner.append(i)
                    which.append(words.setdefault(marked[k : k + LONGEST_WORD], len(words)))
        found = np.zeros(len(words), np.int64)
        every = list(words)
        order = sorted(range(len(every)), key=lambda k: len(every[k]))
        at = 0
        while at < len(order):
            # Words of like length in blocks of bounded memory.
            rows = max(1, BLOCK_CELLS // (self.longest * max(1, len(every[order[min(len(order), at + 256) - 1]]))))
            block = order[at : at + min(rows, 256)]
            found[block] = self.segment([every[k] for k in block])
            at += len(block)
        return np.bincount(np.array(owner, np.int64), found[which], len(texts)).astype(np.int64) if owner else np.zeros(len(texts), np.int64)


def _counted(shared, build: Callable) -> Callable:
    """A column function of a string or binary column; build makes what counts from the broadcast value, once a task."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = build(shared.value)
        for texts in batches:
            own = [t for t in texts if t is not None]
            out = pd.Series([None] * len(texts), dtype="Int64")
            out[np.flatnonzero([t is not None for t in texts])] = counter.count_all([t.encode() if isinstance(t, str) else bytes(t) for t in own])
            yield out

    return count


def bpe_udf(spark: SparkSession, ranks: dict[bytes, int]) -> Callable:
    return _counted(spark.sparkContext.broadcast(ranks), PairRanks)


def pieces_udf(spark: SparkSession, rows: list[tuple[bytes, float, int]]) -> Callable:
    return _counted(spark.sparkContext.broadcast(rows), Pieces)
