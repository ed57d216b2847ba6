"""The other operators of the subpackage: brute force, exact round trips and edge cases on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtally.llm import bpe, chat, lm_score, media, mixing, ngram_join, pu_quality, quality_rules, sharding, textscan, url_rules
from loomtally.llm.queries import URL_RULES, VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " \n\t", "one", "One two", "a b c a b c a b c", "x" * 3000, "line\nline\nother line\n", "é ñ <|endoftext|> '’ 12½ 日本 don't I'LL", "!! $$ ## ok", "A\x1cB\x85C", "\U0001f600 z"]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i, t, None, None if i % 5 == 0 else f"s{i % 4}", None) for i, t in enumerate(texts)]
    if extra:
        rows += [rows[3], rows[3], (None, "null id words", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


CLASHES = (
    "n_words", "kept", "Size", "shard", "slot", "n_tokens", "Score", "Digest", "offset", "target", "Host", "rule", "_f", "fail_bits", "N_Lines", "_t", "_w", "_l", "_s", "_u", "_n", "_h", "_b", "_text", "_row", "_id",
    "_whole", "_source", "_key", "_text_hash", "Copies", "feature", "Width", "held_OUT", "_all", "a.b",
)


def clashing(df):
    """With columns whose names clash with those of results and with those that operators use inside, in any case of letters."""
    return df.select("*", *[F.lit("own").alias(c) for c in CLASHES])


def test_every_operator_with_clashing_names_and_edge_rows(spark, monkeypatch):
    """Nulls in any column, empty and very long texts (longer than a window), ties, repeated rows, empty tables, clashing names."""
    monkeypatch.setattr(lm_score, "WINDOW_BYTES", 2000)
    monkeypatch.setattr(bpe, "WINDOW_BYTES", 2000)
    monkeypatch.setattr(ngram_join, "WINDOW_BYTES", 2000)
    long = " ".join(random_texts(1, 40, 500, 90))
    df = clashing(docs(spark, [*TEXTS, long, long, None])).cache()
    labels = spark.createDataFrame([(None, None, None), (1, 1, 0), (2, 0, None), (4, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    pages = clashing(spark.createDataFrame([(1, "http://net/a"), (1, "http://net/a"), (None, None), (2, ""), (3, "http://NET/" + "x" * 5000)], "page_id long, url string"))
    rules = spark.createDataFrame([("net", "/", "block"), ("net", "/", "allow"), (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    operators = [
        (ngram_join.jaccard_components, df), (ngram_join.keep_one, df), (lambda x: pu_quality.score_quality(x, labels), df), (lambda x: pu_quality.keep_good(x, labels), df),
        (lambda x: media.fill_metadata(media.read_payloads(media.write_shards(x))), df), (mixing.plan_mix, df), (mixing.mix, df), (lambda x: url_rules.judge_urls(x, rules), pages),
        (sharding.assign_shards, df), (quality_rules.ledger, df), (quality_rules.keep_documents, df), (lm_score.score_texts, df), (lambda x: bpe.encode_texts(x, VOCABULARY, digests=True), df),
    ]
    same = {1, 3, 6, 10}
    for k, (operator, table) in enumerate(operators):
        out = operator(table)
        rows = out.collect()
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        if k in same:
            assert out.columns == table.columns
        else:
            assert len(rows) == table.count()
        assert operator(table.limit(0)).collect() == []
    twice = df.where("doc_id = 12").count()
    assert twice == 1


def test_repeated_messages_and_null_ids(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 2, 1, "assistant", "b", 1.0), (1, None, 2, "user", "lost", 9.0), (2, 5, 5, "user", "own parent", 0.0)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    got = chat.parse_conversations(chat.format_conversations(df)).collect()
    assert [(r.tree, [t.text for t in r.turns]) for r in got] == [(1, ["q", "a"])]


def test_feature_equals_plain_loops():
    for n in (64, 128, 640, 64 * 13):
        payload = random.Random(n).randbytes(n)
        h, mean = n // 64, sum(payload) / n
        bits = ""
        for i in range(8):
            a, b = i * h // 8, max(i * h // 8 + 1, (i + 1) * h // 8)
            for j in range(8):
                cell = [payload[y * 64 + x] for y in range(a, b) for x in range(8 * j, 8 * j + 8)]
                bits += str(int(sum(cell) * n > sum(payload) * len(cell)))
        std = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
        assert media.image_feature(payload) == f"grey8:64x{h}:mean={mean:.3f}:std={std:.3f}:ahash={int(bits, 2):016x}"


def test_shards_close_though_equal_texts_keep_them_small(spark, monkeypatch):
    monkeypatch.setattr(media, "SHARD_ROWS", 5)
    refs = media.write_shards(docs(spark, ["same"] * 23, extra=False).coalesce(1)).collect()
    assert len(refs) == 23 and len({r.shard for r in refs}) == 5


def test_urls_above_every_character(spark):
    rules = [*URL_RULES, ("a\x01b.net", "/\U0010ffff", "allow")]
    urls = ["http://net/\U0010ffffx", "http://a\x01b.net/\U0010ffff\U0010ffffz", "http://a.net/", "http://a\x02\x04b.net/\U0010ffff", "http://\x01.net/\x01"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(i, *brute_url(u, rules)) for i, u in enumerate(urls)]


def random_texts(seed, n, vocabulary=60, longest=90):
    rnd = random.Random(seed)
    return [" ".join(f"w{int(vocabulary * rnd.random() ** 3)}" for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_textscan():
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("ab \nÀ\t") for _ in range(rnd.randint(0, 50))) for _ in range(300)]
    data, bounds = textscan.text_bytes(pa.array(texts))
    starts, ends, firsts = textscan.find_words(data, bounds)
    hashes = textscan.hash_words(data, starts, ends)
    seen = {}
    for i, t in enumerate(texts):
        own = [data[starts[k] : ends[k]].tobytes().decode() for k in range(firsts[i], firsts[i + 1])]
        assert own == words(t)
        for k, w in enumerate(own):
            assert seen.setdefault(w, hashes[firsts[i] + k]) == hashes[firsts[i] + k]
    assert len(set(seen.values())) == len(seen)
    assert [b - a for a, b, *_ in textscan.windows(pa.array(["a" * 10] * 5), 20)] == [2, 2, 1]


def brute_rules(text):
    t, w = text or "", words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    texts = TEXTS + random_texts(3, 40, 8) + random_texts(4, 20, 500, 200)
    df = clashing(docs(spark, texts))
    entries = quality_rules.ledger(df).cache()
    for r in entries.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text)
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert base == bool(r.fail_bits & quality_rules.BASE.mask)
    kept = quality_rules.apply_policy(entries.drop("kept"), quality_rules.STRICT).where("kept")
    assert quality_rules.keep_documents(df).count() == kept.count()
    assert quality_rules.keep_documents(df).columns == df.columns
    bits = [r.fail_bits for r in entries.collect()]
    for r in quality_rules.ablation(entries, quality_rules.STRICT).collect():
        bit = 1 << list(quality_rules.RULES).index(r.rule)
        assert (r.failed, r.only_this, r.kept_without) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(not b & ~bit for b in bits))
    assert quality_rules.ledger(df.limit(0)).collect() == [] and quality_rules.keep_documents(df.limit(0)).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rnd = random.Random(seed)
    texts = random_texts(seed, 300)
    rows = [(i, t, None, rnd.choice([None, "a", "b", "c", "é", "d"] if rnd.random() < 0.5 else ["big"]), None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan_mix(df).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    target, taken, largest = brute_targets(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(df.repartition(7)).collect()))
    assert mixing.mix(df).count() == sum(r.copies for r in got) and mixing.mix(df).columns == df.columns


def test_mixing_edges(spark):
    df = clashing(docs(spark))
    assert mixing.plan_mix(df).count() == df.count() and mixing.plan_mix(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    keys = np.random.default_rng(1).integers(0, 2**64, 500, np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    df = clashing(docs(spark, TEXTS + random_texts(5, 600)))
    got = sharding.assign_shards(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 and r.law == "key"
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    text = {i: t for i, t in enumerate(TEXTS)}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got if r.doc_id in text)
    assert sharding.assign_shards(df.limit(0)).collect() == []


def test_media(spark, monkeypatch):
    df = clashing(docs(spark, TEXTS + ["y" * 64, "z" * 65]))
    refs = media.write_shards(df, shard_bytes=4096)
    rows = media.fill_metadata(media.read_payloads(refs)).collect()
    assert len(rows) == df.count()
    text = dict(enumerate(TEXTS + ["y" * 64, "z" * 65])) | {None: "null id words"}
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.read_member(r.shard, r.offset, r.length).getvalue()
        assert (r.media_bytes, r.media_sha256, r.width, r.height, r.bits) == (len(stored), hashlib.sha256(stored).hexdigest(), 64, len(payload) // 64, 8)
    assert len({r.shard for r in rows}) > 1
    assert media.read_payloads(media.write_shards(df.limit(0))).collect() == []
    with pytest.raises(ValueError):
        media.decode_png(stored[:-20] + b"\0" * 20)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <b> [INST] \\ <|end|>\n"), (1, 1, "assistant", "x\\<y["), (1, 2, "ro<le\n", None), (2, 5, "assistant", "<"), (2, 5, "assistant", "<"), (3, 0, None, "|>"), (3, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.parse_conversations(chat.format_conversations(chat.linear_messages(df))).collect()}
    for conv in (1, 2, 3):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == own
        assert list(got[conv].loss) == [t for r, t in own if r == "assistant"]
        assert got[conv].formatted.count("<|turn|>") == len(own) and "[INST]" not in got[conv].formatted
    assert chat.format_conversations(chat.linear_messages(df.limit(0))).collect() == []


def test_reply_trees(spark):
    rnd = random.Random(4)
    messages, parents = [], {}
    for tree in range(6):
        for i in range(rnd.choice([1, 2, 9, 40])):
            parents[tree, i] = rnd.randrange(i) if i and rnd.random() < 0.95 else (999 if rnd.random() < 0.5 else None)
            messages.append((tree, i, parents[tree, i], "user", f"m{i}", rnd.random()))
    messages += [(9, 0, 1, "user", "cycle", 0.0), (9, 1, 0, "user", "cycle", 0.0), (9, 2, 1, "user", "tail", 0.0)]
    df = spark.createDataFrame(messages, "tree long, id long, parent long, role string, text string, score double")
    inner = {(t, p) for (t, _), p in parents.items()}
    expected = defaultdict(list)
    for tree, i, *_ in messages[:-3]:
        if (tree, i) not in inner:
            at = i
            while at is not None and (tree, at) in parents:
                expected[tree, i].append(at)
                at = parents[tree, at]
    got = defaultdict(dict)
    for r in chat.reply_paths(df).collect():
        got[r.tree, r.leaf][r.up] = r.id
    assert {k: [v[u] for u in sorted(v)] for k, v in got.items()} == dict(expected)
    score = {(t, i): s for t, i, _, _, _, s in messages}
    best = {}
    for (tree, leaf), path in expected.items():
        best[tree] = max(best.get(tree, (-1, 0, 0)), (sum(score[tree, i] for i in path), len(path), -leaf))
    chosen = {r.tree: -r.leaf for r in chat.ranked_branches(df).select("tree", "leaf").distinct().collect()}
    assert chosen == {t: b[2] for t, b in best.items()}


def brute_url(url, rules):
    m = re.match(r"(?s:.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and host and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rnd = random.Random(6)
    pick = lambda *x: rnd.choice(x)
    rules = [*URL_RULES, ("a.example.net", "/", "block"), ("a.example.net", "/en", "allow"), ("example.net", "/en/x", "block"), ("b", "/p", "block")]
    urls = [None, "", "no scheme", "http://", "://x", "HTTP://A.Example.NET/en/x?q#f", "http://net", "http://net/", "http://xnet/", "http://a.b/p1", "ftp://org/fr/?x://y", "http://fr.ORG?/fr/", "http://a-b.net/", "http://x.éa.org/fr/é"]
    urls += [f"{pick('http', 'x')}://{pick('', 'a.', 'b.a.', 'x-')}{pick('example.net', 'example.com', 'org', 'net', 'b', 'example.org')}{pick('', '/')}{pick('', 'en', 'en/', 'en/x', 'de/', 'fr/', 'p')}{pick('', '?q', '#f')}" for _ in range(400)]
    df = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[5]), (None, urls[6])], "page_id long, url string"))
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.judge_urls(df, frame).collect()
    assert len(got) == df.count()
    for r in got:
        if r.page_id is not None and r.page_id != 3:
            assert (r.host, r.path, r.rule, r.verdict) == brute_url(urls[r.page_id], rules), urls[r.page_id]
    assert url_rules.judge_urls(df.limit(0), frame).collect() == []
    assert {r.verdict for r in url_rules.judge_urls(df, frame.limit(0)).collect()} == {"allow"}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(7)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(" \n'stl9²éあ <|>\x1c　.,") for _ in range(rnd.randint(0, 40))) for _ in range(500)] + ["a" * 2000 + " " * 50 + "é" * 99, "<|endoftext|>" * 3]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    with open(VOCABULARY, encoding="utf-8") as file:
        model = bpe.ByteLevelBPE(file.read())
    assert model.encode(texts) == expected
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_texts(clashing(df), VOCABULARY).collect()}
    digests = {r.doc_id: r for r in bpe.encode_texts(clashing(df), VOCABULARY, digests=True).collect()}
    for i, ids in enumerate(expected):
        assert list(got[i].ids) == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    assert list(got[None].ids) == [] and bpe.encode_texts(df.limit(0), VOCABULARY).collect() == []


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "WINDOW_BYTES", 4000)
    monkeypatch.setattr(lm_score, "FRAGMENT_BYTES", 4000)
    texts = TEXTS + random_texts(8, 150, 300)
    df = docs(spark, texts)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    low = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)] + [0]
    rows = df.collect()
    counts = Counter(w for r in rows if not held(r.doc_id) for w in low(r.text))
    n, v = sum(counts.values()), len(counts)
    got = lm_score.score_texts(clashing(df), head=40, filter_bits=1 << 16).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in rows}
    for r in got:
        own = low(by_id[r.doc_id].text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(w in counts for w in own), n)
        assert abs(r.base_score - sum(log10((counts[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        assert r.score <= 0
    assert lm_score.score_texts(df.limit(0)).collect() == []
    # A filter with room for all answers the level of every count, and few others.
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 3000, np.uint64))
    c = np.random.default_rng(3).integers(1, 5000, len(keys))
    bits, cutoff = lm_score._chunk(keys.astype(np.uint32), c, 1 << 20)
    bloom = lm_score.Filter(bits, 1, 1 << 20)
    assert cutoff == 1 and (bloom.level(keys) >= lm_score._levels(c)).all() and (bloom.level(keys) > lm_score._levels(c)).mean() < 0.01
    assert (bloom.level(keys + np.uint64(1)) > 0).mean() < 0.02


def test_lm_filter_grows_with_what_it_holds(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FRAGMENT_BYTES", 4000)
    df = docs(spark, random_texts(8, 150, 300), extra=False)
    wide = {r.doc_id: r for r in lm_score.score_texts(df, filter_bits=1 << 24).collect()}
    for head in (0, 40):
        got = lm_score.score_texts(df, head=head, filter_bits=64).collect()
        assert len(got) == len(wide)
        # No n-gram is dropped: at the design load one probe in 64 errs, so scores differ by little.
        assert sum(abs(r.score - wide[r.doc_id].score) for r in got) < 0.05 * sum(r.n_tokens for r in got)
        assert all(r.base_score == pytest.approx(wide[r.doc_id].base_score) and r.n_known == wide[r.doc_id].n_known for r in got)


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "WINDOW_BYTES", 4000)
    monkeypatch.setattr(lm_score, "FRAGMENT_BYTES", 4000)
    texts = TEXTS + random_texts(8, 150, 300)
    rows = docs(spark, texts).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    low = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)] + [0]
    paired = lambda own: list(zip([0] + own[:-1], own))
    singles = Counter(w for r in rows if not held(r.doc_id) for w in low(r.text))
    pairs = Counter(p for r in rows if not held(r.doc_id) for p in paired(low(r.text)))
    middle = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0.0
    whole = sum(singles.values()) + len(singles) + 1
    p = lambda u, w: min(1, (middle(pairs[u, w]) + lm_score.MU * (middle(singles[w]) + 1) / whole) / (middle(singles[u]) + lm_score.MU))
    by_id = {r.doc_id: r for r in rows}
    once = sum(pairs[x] == 1 for r in rows if held(r.doc_id) for x in paired(low(r.text)))
    assert once > 50
    for r in lm_score.score_texts(docs(spark, texts), head=40, filter_bits=1 << 24).collect():
        assert r.score == pytest.approx(sum(log10(p(u, w)) for u, w in paired(low(by_id[r.doc_id].text))), abs=1e-6)


def test_quality_classifier(spark):
    rnd = random.Random(9)
    good = [" ".join("".join(rnd.choice("etaoins") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(60, 200))).capitalize() + "." for _ in range(260)]
    bad = [" ".join([rnd.choice(["BUY!!", "###", "spam"])] * rnd.randint(60, 200)) for _ in range(60)]
    texts = good + bad + ["", None]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(260, 300)] + [(5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    df = clashing(docs(spark, texts, extra=False))
    got = {r.doc_id: r for r in pu_quality.score_quality(df, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    fresh = lambda ids: np.mean([got[i].predicted for i in ids if got[i].held_out or i >= 200])
    assert fresh(range(260)) > 0.95 and fresh(range(260, 320)) < 0.05
    kept = pu_quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert pu_quality.score_quality(df.limit(0), labels).collect() == []
    assert {r.score for r in pu_quality.score_quality(df.limit(3), labels.limit(0)).collect()} == {0.5}
    assert pu_quality.keep_good(df.limit(3), labels.limit(0)).count() == 3


def test_quality_prior_and_risk_equal_brute_force():
    rnd = np.random.default_rng(3)
    for share in (0.2, 0.6, 0.95):
        good = np.repeat([True, False], [round(4000 * share), 4000 - round(4000 * share)])
        f = rnd.normal(0, 1, (4000, pu_quality.WIDTH))
        f[good, 0] += 4
        p = good & (rnd.random(4000) < 0.5)

        def total(of, f=f, p=p):
            return of(f, p)

        blank = lambda f=f: pu_quality.Model(f.mean(0), f.std(0), np.zeros(pu_quality.WIDTH + 1))
        first = pu_quality._newton(total, blank(), None)
        at = np.minimum(1023, 1024 / (1 + np.exp(-first.value(f)))).astype(int)
        prior = pu_quality.estimated_prior(np.bincount(at, minlength=1024), np.bincount(at[p], minlength=1024))
        # The least ratio over all thresholds that nine in ten positives pass can't be far below it.
        assert abs(prior - share) < 0.06
        assert prior <= min((at >= c).mean() / (at[p] >= c).mean() for c in range(1024) if (at[p] >= c).mean() > 0.9) + 0.02
        model = pu_quality._newton(total, blank(), prior)
        z = model.inputs(f)

        def risk(w, z=z, p=p, prior=prior):
            g = z @ w
            negative = np.log1p(np.exp(g)).mean() - prior * np.log1p(np.exp(g[p])).mean()
            return prior * np.log1p(np.exp(-g[p])).mean() + max(0, negative) + (pu_quality.RIDGE + pu_quality.RIDGE_SMALL / p.sum()) * (w[:-1] ** 2).sum() / 2, negative

        least, negative = risk(model.weights)
        assert least < risk(np.zeros(len(model.weights)))[0]
        if abs(negative) > 1e-3:  # the risk is convex: no weight can be moved to lower it; at the clamp's edge the steps are shorter
            assert all(risk(model.weights + 0.05 * s * np.eye(len(model.weights))[k])[0] > least - 1e-4 for k in range(6) for s in (1, -1))
        assert ((model.value(f) > 0) == good).mean() > 0.9


def test_quality_sums_and_scores_equal_numpy(spark):
    rnd = np.random.default_rng(5)
    f = rnd.normal(0, 1, (500, pu_quality.WIDTH)).astype(np.float32)
    table = spark.createDataFrame([(x.tolist(), bool(k % 3 == 0)) for k, x in enumerate(f)], "_f array<float>, _p boolean").repartition(5)
    got = pu_quality.sums(table, lambda f, p: np.concatenate([[len(f), p.sum()], f[p].sum(0)]))
    assert got[:2].tolist() == [500, 167] and np.allclose(got[2:], f[::3].astype(float).sum(0))
    model = pu_quality.Model(f.mean(0).astype(float), f.std(0).astype(float), rnd.normal(0, 1, pu_quality.WIDTH + 1))
    scores = sorted(r.s for r in table.select(model.score(F.col("_f")).alias("s")).collect())
    assert np.allclose(scores, np.sort(1 / (1 + np.exp(-model.value(f.astype(float))))))


def test_chat_of_a_null_conversation(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (None, 2, "user", "r"), (1, 0, "user", "x"), (1, 1, "assistant", "y")]
    messages = chat.linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.tree: [t.text for t in r.turns] for r in chat.parse_conversations(chat.format_conversations(messages)).collect()}
    assert got == {None: ["q", "a", "r"], 1: ["x", "y"]}
    assert messages.schema["tree"] == chat.reply_paths(messages).schema["tree"]
