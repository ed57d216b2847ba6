"""The n-gram join against brute force over all pairs."""

from __future__ import annotations

import random
import re

from loomtally.llm import ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets[i] = grams
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rnd.choices(vocabulary, k=60)
    texts = []
    while len(texts) < n:
        kind = rnd.random()
        if kind < 0.1:
            texts.append(rnd.choice(["", " \n", None, "one", "One two", "a b c d", "a b c d e", "A B C D E"]))
            continue
        base = rnd.choices(vocabulary, k=rnd.choice([5, 7, 30, 60, 200]))
        if kind < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
                at = rnd.randrange(len(copy))
                copy[at : at + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [copy[at], rnd.choice(vocabulary)]])
                copy = copy or ["x"]
            texts.append(" ".join(copy) if rnd.random() < 0.8 else " ".join(copy).upper())
    rnd.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "WINDOW_BYTES", 9000)  # several windows and fragments
    for seed in range(3):
        if seed:  # joins without a broadcast, and lists in several blocks; in the last, no round of pivots before them
            monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
            monkeypatch.setattr(ngram_join, "BLOCK", 3)
            monkeypatch.setattr(ngram_join, "ROUNDS", 2 - seed)
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_thresholds_at_the_edge(spark):
    words = [f"w{k}" for k in range(11)]
    # 7 shingles against 6 of them and one more: 6 / 8 links; 5 / 8 does not.
    rows = [(1, " ".join(words)), (2, " ".join([*words[:10], "x"])), (3, " ".join(["y", *words[1:10], "x"]))]
    assert run(spark, rows) == brute(rows)


def test_empty_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f", None, None, 1), (5, "a b c d e f", None, None, 1), (3, "A b c d e f", "x", "s", 2), (None, "q", None, None, None), (9, None, None, None, None)], SCHEMA)
    got = sorted([(r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df.withColumn("n", df.doc_id)).collect()], key=str)
    assert got == sorted([(False, 5, 2, 3), (False, 5, 2, 3), (False, 3, 2, 3), (True, None, 1, None), (False, 9, 0, 9)], key=str)
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(df).collect()) == ["3", "9", "None"]
    assert ngram_join.jaccard_components(df.limit(0)).collect() == []
    assert ngram_join.keep_one(df.limit(0)).collect() == []


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text that no other row has")]
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()) == [rows[0], rows[2]]
    assert ngram_join.keep_one(df).columns == df.columns
