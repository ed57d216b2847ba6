"""Token counts: the estimate, BPE and pieces."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomtally.functions.tokens import CJK_RANGES, approx_tokens, approx_tokens_binary
from loomtally.operators import vocab_tokens
from loomtally.operators.vocab_tokens import PairRanks, Pieces, bpe_count, bpe_udf, pieces_udf
from loomtally.queries import hand_made_pieces, hand_made_ranks


def estimate(data: bytes) -> int:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        high = sum(b > 127 for b in data)
        return int(0.5 * high + (len(data) - high) / 4)
    total = 0.0
    for c in text:
        total += 0.25 if ord(c) < 128 else 1 if any(a <= ord(c) <= b for a, b in CJK_RANGES) else len(c.encode()) / 2
    return int(total)


def test_estimate(spark):
    texts = ["hello world hello x", "你好世界", "", "\n", "𠀀é〇", "한국어 かな", "a" * 1001]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(approx_tokens(F.col("t"))).collect()] == [estimate(t.encode()) for t in texts]
    assert estimate(b"hello world hello x") == 4 and estimate("你好世界".encode()) == 4
    data = [t.encode() for t in texts] + [b"\xff\xfeab", b"\xc3", "é".encode() * 3]
    df = spark.createDataFrame([(bytearray(b),) for b in data], "b binary")
    assert [r[0] for r in df.select(approx_tokens_binary(F.col("b"))).collect()] == [estimate(b) for b in data]


def textbook(data: bytes, ranks: dict[bytes, int]) -> int:
    parts = [bytes([b]) for b in data]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return len(parts)
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_bpe(spark):
    base = {bytes([b]): b for b in range(256)}
    ranks = base | {b"ab": 256, b"cd": 257}
    assert [bpe_count(x, ranks) for x in (b"abcd", b"axcd", b"")] == [2, 3, 0]
    assert bpe_count(b"abc", base | {b"ab": 256, b"bc": 257}) == 2
    assert bpe_count(b"aaa", base | {b"aa": 256}) == 2
    rnd, ranks = random.Random(1), hand_made_ranks()
    texts = ["".join(rnd.choice("etaoin hdg é") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    assert [bpe_count(t.encode(), ranks) for t in texts] == [textbook(t.encode(), ranks) for t in texts]
    together = PairRanks(ranks)
    assert together.rising and together.count_all([t.encode() for t in texts]).tolist() == [textbook(t.encode(), ranks) for t in texts]
    for seed in range(20):  # vocabularies of a few letters: chains, runs, and ranks that do not rise
        rnd = random.Random(seed)
        tokens = list(dict.fromkeys("".join(rnd.choice("ab") for _ in range(rnd.randint(2, 4))).encode() for _ in range(9)))
        tokens = sorted(tokens, key=len) if seed % 2 else tokens
        own = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        runs = [("".join(rnd.choice("aab") for _ in range(rnd.randint(0, 40)))).encode() for _ in range(40)]
        assert PairRanks(own).count_all(runs).tolist() == [textbook(t, own) for t in runs] == [bpe_count(t, own) for t in runs]
    assert any(PairRanks({b"a": 0, b"ab": 1, b"abb": 2}).rising for _ in "x") and not PairRanks({b"abb": 0, b"ab": 1}).rising
    df = spark.createDataFrame([(t,) for t in [*texts[:20], None]], "t string")
    assert [r[0] for r in df.select(bpe_udf(spark, ranks)(F.col("t"))).collect()] == [bpe_count(t.encode(), ranks) for t in texts[:20]] + [None]


def best_cut(word: bytes, rows, memo):
    """The best segmentation by trying every last piece: (score, last pieces' lengths from the end, number of pieces)."""
    normal, single = {}, {}
    for piece, score, kind in rows:
        if kind == 1:
            normal.setdefault(piece, score)
        elif kind == 6:
            single[int(piece[3:-1], 16)] = score
    unknown = next((s for _, s, k in reversed(rows) if k == 2), None)
    table = {0: (0.0, 0)}
    for j in range(1, len(word) + 1):
        ways = [(table[i][0] + normal[word[i:j]], j - i, table[i][1] + 1) for i in range(j) if i in table and word[i:j] in normal]
        alone = single.get(word[j - 1], unknown)
        if alone is not None and j - 1 in table:
            ways.append((table[j - 1][0] + alone, 0, table[j - 1][1] + 1))
        if ways:
            top = max(ways)
            table[j] = (top[0], top[2])
    return table[len(word)][1] if len(word) in table else -(-len(word) // 4)


def test_pieces(spark, monkeypatch):
    rows = [(b"<unk>", -10.0, 2), (b"x", -1.0, 1), (b"xy", -1.5, 1), (b"y", -1.0, 1), ("▁x".encode(), -1.0, 1), (b"<0x7A>", -2.0, 6)]
    assert Pieces(rows).count_all([b"xy", b"yx", b" x", b"z", b"x\ny\t", b""]).tolist() == [1, 2, 1, 1, 2, 0]
    df = spark.createDataFrame([("xy x",), (None,)], "t string")
    assert [r[0] for r in df.select(pieces_udf(spark, rows)(F.col("t"))).collect()] == [2, None]
    assert Pieces([(b"zz", -1.0, 1)]).count_all([b"a" * 9]).tolist() == [3]
    rnd = random.Random(3)
    words = ["".join(rnd.choice("tainö ho") for _ in range(rnd.randint(1, 50))).replace(" ", "▁").encode() for _ in range(200)]
    for own in (hand_made_pieces(), rows, [(b"t", -1.0, 1), (b"ta", -2.0, 1), (b"a", -1.0, 1), (b"tai", -3.0, 1)], rows[1:]):
        for cells in (1 << 20, 64):
            monkeypatch.setattr(vocab_tokens, "BLOCK_CELLS", cells)
            assert Pieces(own).count_all(words).tolist() == [best_cut(w, own, {}) for w in words]
    long = b"ta" * 3000
    assert Pieces(hand_made_pieces()).count_all([long]).tolist() == [sum(best_cut(long[k : k + 2048], hand_made_pieces(), {}) for k in range(0, len(long), 2048))]
