"""BPE encoding and decoding with a pair occurrence index.

A text is cut into the added tokens that stand in it and, between them, into the pieces of the byte-level pre-tokenizer. The distinct
pieces of a window of a partition that were not met before are encoded together: an index maps each pair that has a rank to all its positions in all
those pieces, and the active ranks are applied in ascending order from a heap, each at all positions of its pair; a merge updates the lists of
the two pairs beside it alone. Pieces met before are looked up, in a memo of bounded size.

Defined results: a null or empty text has no tokens, the digests of the empty string, and decodes to the empty text; equal texts
have equal results; very long pieces cost n log n; an empty table gives an empty result; extra columns pass through unless they clash with a
result column, in any case of letters.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.llm import textscan
from loomtally.llm.shared import pack, quoted, unpack

#: Distinct pieces that a worker remembers, and bytes of text that are encoded together.
MEMO_PIECES = 400_000
WINDOW_BYTES = 2 << 20

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
#: Texts of these characters alone (ASCII, and Latin-1 without its digits and blanks) are cut by the standard library, twice as fast.
_SIMPLE = f"\\t\\n\\x0b\\x0c\\r -~¡-¬®-±´¶-¸»¿×÷{_LETTERS}"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class ByteLevelBPE:
    """A byte-level BPE vocabulary read from a tokenizer.json; encodes and decodes batches of texts."""

    def __init__(self, text: str) -> None:
        import regex

        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        alphabet = byte_alphabet()
        value = {c: b for b, c in enumerate(alphabet)}
        self.first = [vocab[c] for c in alphabet]
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.names = [str(i) for i in range(size)]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.strange = re.compile(f"[^{_SIMPLE}]")
        self.quick = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
        blank = r"\p{White_Space}"
        self.full = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{blank}\p{{L}}\p{{N}}]+|{blank}+(?=$|{blank})|{blank}+".replace("(?=$|", r"(?=\Z|"))
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.byte_sizes = np.array([len(b) for b in self.bytes])
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        width = len(str(size)) + 1
        self.digits = np.frombuffer(b"".join(f"{i},".encode().ljust(width, b"\0") for i in range(size)), np.uint8).reshape(size, width)
        self.digit_sizes = (self.digits != 0).sum(axis=1)
        # Classes of bytes: 1 letters, 2 digits, 3 blanks, 4 others, 5 what only the patterns can cut.
        self.kinds = np.full(256, 5, np.uint8)
        self.kinds[33:127] = 4
        self.kinds[[9, 10, 11, 12, 13, 32]] = 3
        self.kinds[48:58] = 2
        self.kinds[[*range(65, 91), *range(97, 123)]] = 1
        self.kinds_c3, self.kinds_c2 = np.full(256, 1, np.uint8), np.full(256, 4, np.uint8)
        self.kinds_c3[[0x97, 0xB7]] = 4
        self.kinds_c2[[0xAA, 0xB5, 0xBA]] = 1
        self.kinds_c2[[*range(0x80, 0xA1), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 5
        self.memo: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        return (self.full if self.strange.search(text) else self.quick).findall(text)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of distinct pieces. The index: from each pair to the positions of its first token, and a heap of the active ranks."""
        first, rank = self.first, self.rank
        sym: list[int] = []
        starts = []
        for piece in pieces:
            starts.append(len(sym))
            sym += [first[b] for b in piece]
            sym.append(-1)  # no pair crosses the end of a piece
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(itertools.pairwise(sym)):
            if pair in rank:
                if pair in places:
                    places[pair].append(i)
                else:
                    places[pair] = [i]
        active = [(rank[p][0], p) for p in places]
        heapq.heapify(active)

        def enter(pair: tuple[int, int], at: int) -> bool:
            """Adds a position to the index; whether it has made a rank active."""
            if pair not in rank:
                return False
            if pair in places:
                places[pair].append(at)
                return False
            places[pair] = [at]
            heapq.heappush(active, (rank[pair][0], pair))
            return True

        while active:
            r, pair = heapq.heappop(active)
            todo = sorted(places.pop(pair))
            left, right, new = *pair, rank[pair][1]
            for done, i in enumerate(todo):
                j = after[i]
                if sym[i] != left or j >= n or sym[j] != right:
                    continue
                k = after[j]
                sym[i], sym[j], after[i] = new, -2, k
                before[k] = i
                lower = enter((new, sym[k]), i)
                h = before[i]
                if h >= 0 and sym[h] >= 0:
                    lower |= enter((sym[h], new), h)
                if lower and active[0][0] < r:
                    # A lower rank is due first: what is left of this pair waits.
                    if rest := todo[done + 1 :]:
                        places[pair] = places.get(pair, []) + rest
                        heapq.heappush(active, (r, pair))
                    break
        out = []
        for s in starts:
            ids, i = [], s
            while sym[i] != -1:
                ids.append(sym[i])
                i = after[i]
            out.append(tuple(ids))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        memo, pieces = self.memo, self.pieces
        # Per text its pieces, or lists of pieces and added tokens where those occur.
        cut = [pieces(x) if self.cut is None or not self.cut.search(x) else [t if t in self.added else pieces(t) for t in self.cut.split(x) if t] for x in texts]
        mixed = [isinstance(c[0], list) or c[0] in self.added if c else False for c in cut]
        seen: set[str] = set()
        for c, m in zip(cut, mixed, strict=True):
            for part in [p for p in c if isinstance(p, list)] if m else [c]:
                seen.update(part)
        new = [p for p in seen if p not in memo]
        if len(memo) + len(new) > MEMO_PIECES:
            memo.clear()
            new = list(seen)
        memo.update(zip(new, self.merge_all([p.encode() for p in new]), strict=True))
        get, chain = memo.__getitem__, itertools.chain.from_iterable
        out = []
        for c, m in zip(cut, mixed, strict=True):
            if m:
                out.append([i for part in c for i in (chain(map(get, part)) if isinstance(part, list) else (self.added[part],))])
            else:
                out.append(list(chain(map(get, c))))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def cut_bytes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces begin, for all rows at once, and which rows hold characters or added tokens that need the patterns instead.
        The rules of the pre-tokenizer on classes of bytes: a run of letters, digits or other characters is a piece, with a space
        before it; blanks go together but for the last, which is such a space or stands alone; 's and its like are pieces."""
        n = len(data)
        kind = self.kinds[data]
        lead = np.flatnonzero(data >= 0xC0)
        lead = lead[lead + 1 < n]
        after = data[lead + 1]
        sort = np.where(data[lead] == 0xC3, self.kinds_c3[after], np.where(data[lead] == 0xC2, self.kinds_c2[after], 5)).astype(np.uint8)
        kind[lead] = sort
        kind[lead + 1] = sort
        full = bounds[:-1] < bounds[1:]
        heads = bounds[:-1][full]
        strange = np.zeros(len(bounds) - 1, bool)
        odd = np.flatnonzero(kind == 5)
        strange[np.searchsorted(bounds, odd, "right") - 1] = True
        text = data.tobytes()
        for token in self.added:
            at = text.find(token.encode())
            while at >= 0:
                strange[np.searchsorted(bounds, at, "right") - 1] = True
                at = text.find(token.encode(), at + 1)
        before = np.empty(n, np.uint8)
        before[1:] = kind[:-1]
        if n:
            before[heads] = 0
        after_space = np.zeros(n, bool)
        after_space[1:] = data[:-1] == 32
        after_space[heads] = False
        blank = kind == 3
        begin = (kind != before) & ~(after_space & ~blank)
        last = np.zeros(n, bool)
        last[:-1] = blank[:-1] & ~blank[1:]
        tails = bounds[1:][full] - 1
        last[tails] = False
        begin |= last
        apostrophe = np.flatnonzero((data == 39) & begin)
        if len(apostrophe):
            end = bounds[np.searchsorted(bounds, apostrophe, "right")]
            wide = np.append(data, np.zeros(3, np.uint8))
            one, two = wide[apostrophe + 1], wide[apostrophe + 2]
            short = np.isin(one, list(b"stmd")) & (apostrophe + 1 < end)
            long = ((np.isin(one, list(b"rv")) & (two == 101)) | ((one == 108) & (two == 108))) & (apostrophe + 2 < end)
            for at, stop, size in ((apostrophe[short], end[short], 2), (apostrophe[long], end[long], 3)):
                begin[at + 1] = False
                at, stop = at + size, stop
                begin[at[(at < stop)]] = True
        return np.flatnonzero(begin), strange

    def encode_bytes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and where each row begins."""
        starts, strange = self.cut_bytes(data, bounds)
        ends = np.append(starts[1:], len(data))
        hashes = textscan.hash_words(data, starts, ends)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        size = ends - starts
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
        masks = np.array([0, *((1 << (8 * k)) - 1 for k in range(1, 9))], np.uint64)
        head = eights[starts] & masks[np.minimum(size, 8)]
        tail = eights[np.maximum(ends - 8, starts)] & masks[np.minimum(size, 8)]
        own = first[which]
        # Pieces of one hash are equal if their lengths, first and last eight bytes are; up to 16 bytes that is all of them.
        if not ((size == size[own]) & (head == head[own]) & (tail == tail[own])).all():
            strange[:] = True
        known = self.known
        at = np.minimum(np.searchsorted(known[0], unique), max(0, len(known[0]) - 1))
        new = np.flatnonzero(known[0][at] != unique) if len(known[0]) else np.arange(len(unique))
        if len(new):
            if len(known[0]) + len(new) > MEMO_PIECES:
                known, new = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)), np.arange(len(unique))
            flat, lengths = self.merge_ranges(data, starts[first[new]], size[first[new]])
            begins = np.cumsum(lengths) - lengths + len(known[3])
            order = np.argsort(joined := np.concatenate([known[0], unique[new]]))
            known = (joined[order], np.concatenate([known[1], begins])[order], np.concatenate([known[2], lengths])[order], np.concatenate([known[3], flat]))
            self.known = known
        at = np.searchsorted(known[0], unique)
        begin, length = known[1][at][which], known[2][at][which]
        row = np.searchsorted(starts, bounds)
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = known[3][spread(begin, length, total)]
        where = total[row]
        if strange.any():
            texts = data.tobytes()
            parts, sizes = [], np.diff(where)
            rows = np.flatnonzero(strange)
            coded = self.encode([texts[bounds[i] : bounds[i + 1]].decode() for i in rows])
            done = 0
            for i, c in zip(rows, coded, strict=True):
                parts += [ids[where[done] : where[i]], np.array(c, np.int32)]
                sizes[i], done = len(c), i + 1
            ids = np.concatenate([*parts, ids[where[done] :]])
            where = np.concatenate(([0], np.cumsum(sizes)))
        return ids, where

    def merge_ranges(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte ranges, one after another, and how many each has."""
        whole = data.tobytes()
        merged = self.merge_all([whole[a : a + n] for a, n in zip(starts.tolist(), size.tolist(), strict=True)])
        lengths = np.fromiter(map(len, merged), np.int64, len(merged))
        return np.fromiter(itertools.chain.from_iterable(merged), np.int32, int(lengths.sum())), lengths

    def decode_bytes(self, ids: np.ndarray, where: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all rows of ids, one after another, and where each row begins."""
        length = self.byte_sizes[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return self.all_bytes[spread(self.byte_starts[ids], length, total)].tobytes(), total[where]

    def joined(self, ids: np.ndarray, where: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Decimal ids, each with a comma after it, and where each row begins."""
        width = self.digits.shape[1]
        flat = self.digits[ids].ravel()
        count = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.digit_sizes[ids], out=count[1:])
        assert width
        return flat[flat != 0].tobytes(), count[where]


def spread(begin: np.ndarray, length: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Indices begin[k] .. begin[k] + length[k] - 1 for all k in a row. total: the sums of length, from 0."""
    return np.repeat(begin - total[:-1], length) + np.arange(total[-1])


def encode_texts(df: DataFrame, vocabulary: str, text: str = "text", digests: bool = False) -> DataFrame:
    """df without its text, with ids array<int> and decoded string; or, with digests, n_tokens and the SHA-256 of both instead.
    vocabulary: path of a tokenizer.json that the driver can read; its text, of a fixed size, is broadcast."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    fields = T._parse_datatype_string(ddl).fields
    own, row = pack(df, (text, *(f.name for f in fields)))
    texts = df.select(*row, F.col(quoted(text)).cast("string").alias("_text"))
    schema = T.StructType([*texts.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of live tuples, none of them in a cycle
        try:
            yield from coded(batches)
        finally:
            gc.enable()  # the worker goes on to other tasks
            textscan.trim()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteLevelBPE(spec.value)
        for batch in batches:
            for a, b, data, bounds in textscan.windows(batch.column(batch.num_columns - 1), WINDOW_BYTES):
                ids, where = model.encode_bytes(data, bounds)
                decoded, begin = model.decode_bytes(ids, where)
                rows = range(b - a)
                # Bytes that aren't UTF-8 are read as the replacement character, as in the vocabulary's own decoder.
                try:
                    decoded.decode()
                    texts = [decoded[begin[i] : begin[i + 1]] for i in rows]
                except UnicodeDecodeError:
                    texts = [decoded[begin[i] : begin[i + 1]].decode("utf-8", "replace").encode() for i in rows]
                if digests:
                    text, at = model.joined(ids, where)
                    extra = [
                        pa.array(np.diff(where), pa.int64()),
                        pa.array([hashlib.sha256(text[at[i] : max(at[i], at[i + 1] - 1)]).hexdigest() for i in rows], pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    ]
                else:
                    lists = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(ids, pa.int32()))
                    extra = [lists, pa.array([t.decode() for t in texts], pa.string())]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *extra], schema.names)

    return texts.mapInArrow(run, schema).select(*unpack(own), *[f.name for f in fields])
