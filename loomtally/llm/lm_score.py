"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counting. Windows of training text send each fragment of the hash range their distinct words and word pairs with counts, so a word of
every document costs a row per window. A fragment sums them. It keeps its words with exact counts, and builds its own chunk of the
filter: every n-gram of count c is inserted at the levels 1 .. 1 + floor(log2 c). A chunk is sized from the insertions counted in it, so that
at most half of its bits are set at any size of the corpus; the filter has FILTER_BITS bits at least. The table of the most frequent words,
HEAD entries at most, is broadcast; the filter never is.

Scoring. The level at which an n-gram's membership probes first fail gives its quantised count, and
P(w | u) = (c(u, w) + MU * P(w)) / (c(u) + MU), P(w) = (c(w) + 1) / (N + V + 1). A window's distinct pairs, and its words beyond the head, go to
their fragments, which probe their chunks and look up the exact counts of the base score; the answers come back to the window.

Defined results: a null or empty text is the end token alone; equal texts have equal scores; a null doc_id counts as an empty text in the fold; without training
rows N and V are 0 and every token has probability 1; an empty table gives an empty result; other columns are not carried. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.llm import textscan
from loomtally.llm.shared import held_out, release, remove, scratch_since, written

FILTER_BITS = 1 << 27
HEAD = 1 << 20
PROBES = 6
LEVELS = 40
MU = 1000.0
FRAGMENT_BYTES = 16 << 20
WINDOW_BYTES = 4 << 20
END = np.uint64(0x0E4D)


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an END after each row's words, and where each row begins."""
    data = textscan.lowered(data)
    starts, ends, firsts = textscan.find_words(data, bounds)
    words = textscan.hash_words(data, starts, ends)
    rows = len(firsts) - 1
    out = np.full(len(words) + rows, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(firsts))] = words
    return out, firsts + np.arange(rows + 1)


def _pairs(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it; a row's first follows an END."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = END
    return textscan.mix(textscan.mix(before + np.uint64(1)) * np.uint64(3) + tokens)


def _fragment(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def _single(words: np.ndarray) -> np.ndarray:
    """The key of a word in the filter, unlike that of any pair."""
    return textscan.mix(words ^ np.uint64(0xC0FFEE))


def _places(low: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """PROBES places in a chunk for each key and level."""
    seed = textscan.mix(low.astype(np.uint64) * np.uint64(64) + np.uint64(level) if np.isscalar(level) else low.astype(np.uint64) * np.uint64(64) + level.astype(np.uint64))
    step = (seed >> np.uint64(32)) | np.uint64(1)
    every = (seed & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)
    return (every % np.uint64(bits)).astype(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(np.log2(np.maximum(counts, 1)))).astype(np.int64)


def _room(levels: np.ndarray, least: int) -> int:
    """The bits of a chunk in which the levels set half of the bits, or least if that is more; whole bytes."""
    return max(64, least, -(-int(np.ceil(levels.sum() * PROBES / np.log(2))) // 8) * 8)


def _chunk(low: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """A chunk's bits, and the lowest count that it holds: 1, as every n-gram is in."""
    levels = _levels(counts)
    out = np.zeros(bits, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = low[levels >= level]
        for a in range(0, len(some), 1 << 18):
            out[_places(some[a : a + (1 << 18)], level, bits).ravel()] = 1
    return np.packbits(out, bitorder="little"), 1


class Filter:
    """The chunks side by side; answers quantised counts."""

    def __init__(self, chunks: np.ndarray, fragments: int, bits: int) -> None:
        self.chunks, self.fragments, self.bits = chunks, fragments, bits

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which every probe finds its bits set."""
        out = np.zeros(len(keys), np.int64)
        base = _fragment(keys, self.fragments).astype(np.int64) * self.bits
        low, going = keys.astype(np.uint32), np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            found = np.empty(len(going), bool)
            for a in range(0, len(going), 1 << 18):
                some = going[a : a + (1 << 18)]
                at = _places(low[some], level, self.bits) + base[some, None]
                found[a : a + (1 << 18)] = ((self.chunks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            going = going[found]
            if not len(going):
                break
            out[going] = level
        return out


def _quantised(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that share the level; 0 where the first probe fails."""
    level = level.astype(np.float64)
    return np.where(level > 0, (2.0 ** (level - 1) + 2.0**level - 1) / 2, 0.0)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, first all lowest bytes and so on: the high ones of small numbers compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def count_ngrams(df: DataFrame, text: str = "text", filter_bits: int = FILTER_BITS) -> tuple[DataFrame, int]:
    """One row per fragment: words and counts (exact), classes (how many words are in each class of counts), tokens, types and the
    fragment's chunk of the filter. Also the number of fragments."""
    spark = df.sparkSession
    rows = df.select(F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(4, -(-size // FRAGMENT_BYTES))
    least = filter_bits // fragments // 8 * 8
    edges = np.arange(fragments + 1, dtype=np.uint64)

    def cut(sorted_hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(_fragment(sorted_hashes, fragments), edges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in textscan.windows(batch.column(0), WINDOW_BYTES):
                tokens, at = _tokens(data, bounds)
                words, n = np.unique(tokens, return_counts=True)
                pairs, m = np.unique(_pairs(tokens, at), return_counts=True)
                a, b = cut(words), cut(pairs)
                # Counts of pairs are two bytes wide; a pair that a window has more often stands there several times.
                times = (m - 1) // 65535 + 1
                if (times > 1).any():
                    last = np.cumsum(times) - 1
                    pairs, m_last = np.repeat(pairs, times), m - (times - 1) * 65535
                    m = np.full(len(pairs), 65535)
                    m[last] = m_last
                    b = cut(pairs)
                low, few, n = pairs.astype(np.uint32), m.astype(np.uint16), n.astype(np.uint32)
                blobs = [[x[c[k] : c[k + 1]].tobytes() for k in range(fragments)] for x, c in ((words, a), (n, a), (low, b), (few, b))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(fragments, dtype=np.int32)), *[pa.array(x, pa.binary()) for x in blobs]], ["frag", "words", "n", "pairs", "m"])

    def total(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[new], np.add.reduceat(counts, new) if len(new) else counts[:0]

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()])
        words, n = total(read("words", np.uint64), read("n", np.uint32).astype(np.int64))
        pairs, m = total(read("pairs", np.uint32), read("m", np.uint16).astype(np.int64))
        classes = np.bincount(np.floor(8 * np.log2(np.maximum(n, 1))).astype(np.int64), minlength=512)
        low, c = np.concatenate([pairs, _single(words).astype(np.uint32)]), np.concatenate([m, n])
        chunk, _ = _chunk(low, c, _room(_levels(c), least))
        own = pa.array
        return pa.table({
            "frag": own([key[0].as_py()], pa.int32()), "words": own([words.tobytes()], pa.binary()), "n": own([n.tobytes()], pa.binary()),
            "classes": own([classes.tolist()], pa.list_(pa.int64())), "tokens": own([int(n.sum())], pa.int64()), "types": own([len(words)], pa.int64()),
            "chunk": own([chunk.tobytes()], pa.binary()),
        })

    sent = rows.mapInArrow(count, "frag int, words binary, n binary, pairs binary, m binary")
    summed = sent.groupBy("frag").applyInArrow(reduce, "frag int, words binary, n binary, classes array<long>, tokens long, types long, chunk binary")
    summed = written(summed, "counts")
    release(spark)
    return summed, fragments


def _own_levels(chunk: bytes, keys: np.ndarray) -> np.ndarray:
    """Levels of keys that fall in the chunk's fragment."""
    return Filter(np.frombuffer(chunk, np.uint8), 1, 8 * len(chunk)).level(keys).astype(np.uint8)


def frequent_words(counts: DataFrame, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, counts and levels in the filter of the most frequent words, in whole classes of counts, at most head of them."""
    per = counts.select(F.posexplode("classes").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c")).orderBy(F.desc("k")).collect()
    least, seen = 512, 0
    for row in per:
        seen += row.c
        if seen > head:
            break
        least = row.k

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n, chunk in zip(*[batch.column(k) for k in range(3)], strict=True):
                w, c = np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)
                keep = np.floor(8 * np.log2(np.maximum(c, 1))) >= least
                levels = _own_levels(chunk.as_py(), _single(w[keep]))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (w[keep], c[keep], levels)], ["words", "n", "levels"])

    got = counts.select("words", "n", "chunk").mapInArrow(top, "words binary, n binary, levels binary").toArrow()
    words, n, levels = [np.concatenate([np.zeros(0, t), *[np.frombuffer(x, t) for x in got[c].to_pylist()]]) for c, t in (("words", np.uint64), ("n", np.int64), ("levels", np.uint8))]
    order = np.argsort(words)
    return words[order], n[order], levels[order]


def _find(sorted_words: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word stands among the sorted ones, and whether it does."""
    if not len(sorted_words):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    place = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return place, sorted_words[place] == words


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, head: int = HEAD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from the rows that are not held out."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key), modulus).alias("held_out"), F.col(text).cast("string").alias("text"))
    known = scratch_since([])
    counts, fragments = count_ngrams(rows.where("not held_out"), "text", filter_bits)
    counted = scratch_since(known)
    facts = counts.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = facts.n or 0, facts.v or 0
    frequent = spark.sparkContext.broadcast(frequent_words(counts, head))
    whole = float(tokens + types + 1)
    edges = np.arange(fragments + 1, dtype=np.uint64)

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in textscan.windows(batch.column(2), WINDOW_BYTES):
                every, at = _tokens(data, bounds)
                unique, which = np.unique(every, return_inverse=True)
                part = batch.slice(first, last - first)
                facts = pa.StructArray.from_arrays([part.column(0), part.column(1), pa.array(np.diff(at))], ["doc_id", "held_out", "n_tokens"])
                docs = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), facts)
                blobs = [pa.array([x], pa.binary()) for x in (unique.tobytes(), _planes(which))]
                del every, unique, which
                textscan.trim()
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), docs, *blobs], ["win", "docs", "words", "which"])

    def read(docs: pa.Array, words: bytes, which: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A window's distinct words, each token's place among them, hashes of its pairs, and where each row begins."""
        at = np.concatenate(([0], np.cumsum(docs.field("n_tokens").to_numpy(zero_copy_only=False)))).astype(np.int64)
        unique, which = np.frombuffer(words, np.uint64), _unplanes(which)
        return unique, which, _pairs(unique[which], at), at

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words = frequent.value[0]
        for batch in batches:
            for i in range(batch.num_rows):
                unique, _, pairs, _ = read(batch.column(1).slice(i, 1).flatten(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                own, pairs = unique[~_find(head_words, unique)[1]], np.unique(pairs)
                a, b, low = np.searchsorted(_fragment(own, fragments), edges), np.searchsorted(_fragment(pairs, fragments), edges), pairs.astype(np.uint32)
                some = np.flatnonzero(np.diff(a) + np.diff(b))
                blobs = [[x[c[k] : c[k + 1]].tobytes() for k in some] for x, c in ((own, a), (low, b))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(some), pa.string()), pa.array(some.astype(np.int32)), *[pa.array(x, pa.binary()) for x in blobs]], ["win", "frag", "words", "pairs"]
                )

    def look_up(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"win": pa.array([], pa.string()), "frag": pa.array([], pa.int32()), **{k: pa.array([], pa.binary()) for k in ("n", "single", "pair")}})
        own, pairs = asked["words"].to_pylist(), asked["pairs"].to_pylist()
        a, b = np.cumsum([0, *[len(x) // 8 for x in own]]), np.cumsum([0, *[len(x) // 4 for x in pairs]])
        own, pairs = np.frombuffer(b"".join(own), np.uint64), np.frombuffer(b"".join(pairs), np.uint32).astype(np.uint64)
        n, single, pair = np.zeros(len(own), np.int64), np.zeros(len(own), np.uint8), np.zeros(len(pairs), np.uint8)
        if known.num_rows:
            place, there = _find(np.frombuffer(known["words"][0].as_py(), np.uint64), own)
            n[there] = np.frombuffer(known["n"][0].as_py(), np.int64)[place[there]]
            chunk = known["chunk"][0].as_py()
            single, pair = _own_levels(chunk, _single(own)), _own_levels(chunk, pairs)
        blobs = {k: pa.array([x[c[i] : c[i + 1]].tobytes() for i in range(asked.num_rows)], pa.binary()) for k, x, c in (("n", n, a), ("single", single, a), ("pair", pair, b))}
        textscan.trim()
        return pa.table({"win": asked["win"], "frag": asked["frag"], **blobs})

    def finish(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        docs = own["docs"].combine_chunks().flatten()
        unique, which, pairs, at = read(docs, own["words"][0].as_py(), own["which"][0].as_py())
        # Fragments are ranges of hashes: their answers, one after another, are in the order of the sorted hashes.
        order = np.argsort(told["frag"].to_numpy())
        answer = lambda c, t: np.frombuffer(b"".join(told[c][int(i)].as_py() for i in order), t)
        head_words, head_n, head_levels = frequent.value
        place, hit = _find(head_words, unique)
        n, level = np.empty(len(unique), np.int64), np.empty(len(unique), np.uint8)
        n[hit], level[hit] = head_n[place[hit]], head_levels[place[hit]]
        n[~hit], level[~hit] = answer("n", np.int64), answer("single", np.uint8)
        row = np.repeat(np.arange(len(docs)), np.diff(at))
        base = np.bincount(row, np.log10((n + 1) / whole)[which], len(docs))
        known = np.bincount(row, (n > 0)[which], len(docs)).astype(np.int64)
        # The model: quantised counts alone.
        single = _quantised(level)
        before = np.empty(len(which), np.float64)
        before[1:] = single[which][:-1]
        before[at[:-1]] = single[np.searchsorted(unique, END)]
        pair = _quantised(answer("pair", np.uint8))[np.unique(pairs, return_inverse=True)[1]]
        smooth = np.minimum(1.0, (np.minimum(pair, before) + MU * ((single + 1) / whole)[which]) / (before + MU))
        del pair, before, single, pairs
        textscan.trim()
        return pa.table({
            "doc_id": docs.field("doc_id"), "held_out": docs.field("held_out"), "n_tokens": docs.field("n_tokens"), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(docs), tokens)), "base_score": pa.array(base), "score": pa.array(np.bincount(row, np.log10(smooth), len(docs))),
        })

    docs_ddl = "array<struct<doc_id:bigint,held_out:boolean,n_tokens:bigint>>"
    own = written(rows.mapInArrow(window, f"win string, docs {docs_ddl}, words binary, which binary"), "windows")
    asked = own.mapInArrow(ask, "win string, frag int, words binary, pairs binary")
    # Answers are written, so that the questions' shuffle is gone before the windows are shuffled.
    told = asked.groupBy("frag").cogroup(counts.select("frag", "words", "n", "chunk").groupBy("frag")).applyInArrow(look_up, "win string, frag int, n binary, single binary, pair binary")
    told = written(told, "told")
    del asked
    remove(spark, counted)
    release(spark)
    return own.groupBy("win").cogroup(told.groupBy("win")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
