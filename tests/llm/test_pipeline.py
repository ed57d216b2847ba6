"""The pipeline's stages on a small table of documents, each against a plain version that uses no Spark."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from test_ngram_join import brute
from test_operators import brute_rules, brute_targets, words
from tokenizers import Tokenizer

from loomtally.llm import pu_quality, quality_rules

SF = "/root/testdata/sf0.001"


def passes_rules(text):
    """Whether a text passes all seven rules, by plain loops."""
    n, chars, symbols, doubles, repeated = brute_rules(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    upper = sum(c.isupper() and c.upper() == c and c.lower() != c for c in text or "")
    shouts = len(re.findall("!![ \t-\r]", text or ""))
    failed = (
        n < 50, 100 * repeated > 50 * n, 100 * symbols > 10 * chars, len(lines) >= 4 and 100 * doubles > 60 * len(lines),
        100 * upper > 50 * chars, chars < 2 * n or chars > 25 * n, 100 * shouts > 10 * n,
    )
    return not any(failed)


def passes_classifier(rows, labels):
    """The ids whose score is at least 0.7: the fit on one array of all rows, the prior by a loop over thresholds."""
    f = pu_quality.text_features(pa.array([r.text for r in rows])).astype(np.float32).astype(np.float64)
    seen = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows])
    p = np.array([labels.get(r.doc_id) == {1} for r in rows])[seen]
    own = f[seen]
    blank = lambda: pu_quality.Model(own.mean(0), own.std(0) + 1e-3, np.zeros(pu_quality.WIDTH + 1))
    half = pu_quality._half(own)
    first = pu_quality._newton(lambda of: of(own[half], p[half]), blank(), None)
    at = np.floor(np.minimum(1023, 1024 / (1 + np.exp(-first.value(own[~half])))))
    mine = at[p[~half]]
    error = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(at)) + 1 / np.sqrt(len(mine)))
    bounds = [((at >= c).mean() / (mine >= c).mean(), (mine >= c).mean()) for c in range(1024) if (mine >= c).any()]
    prior = min(1.0, min(bounds, key=lambda b: b[0] + error / b[1])[0])
    model = pu_quality._newton(lambda of: of(own, p), blank(), prior)
    return {r.doc_id: 1 / (1 + np.exp(-g)) for r, g in zip(rows, model.value(f), strict=True)}


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = [docs]
    for _, work in corpus_pipeline.STAGES:
        results.append(corpus_pipeline.written(work(spark, results[-1], SF), "test"))
    start, kept, good, single, mixed, coded = (r.collect() for r in results)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "ngram_join", "mix_sources", "bpe"]
    assert all(r.columns == docs.columns for r in results[:-1])
    ids = lambda rows: sorted(r.doc_id for r in rows)
    assert ids(kept) == sorted(r.doc_id for r in start if passes_rules(r.text)) and len(start) > len(kept) > 0

    labels = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id].add(r.quality)
    scores = passes_classifier(kept, labels)
    # Sums in another order move a score by less than a thousandth.
    sure = {i for i, s in scores.items() if abs(s - 0.7) > 1e-3}
    assert len(sure) > 0.95 * len(scores) and sure & set(ids(good)) == {i for i in sure if scores[i] >= 0.7}

    classes = brute([(r.doc_id, r.text) for r in good])
    assert ids(single) == sorted({c for _, c in classes.values()})

    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in single:
        sizes[r.source] += len(words(r.text))
        largest[r.source] = max(largest[r.source], len(words(r.text)))
    times = Counter(ids(mixed))
    assert set(times) <= set(ids(single)) and max(times.values()) <= 3
    for r in mixed:
        taken[r.source] += len(words(r.text))
    targets = brute_targets(dict(sizes))
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)

    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    expected = []
    for r in mixed:
        tokens = library.encode(r.text, add_special_tokens=False).ids
        text = library.decode(tokens, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((r.doc_id, len(tokens), digest(",".join(map(str, tokens))), digest(text)))
    found = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded)
    assert found == sorted(expected)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in again) == found


def test_stages_of_edge_rows(spark):
    """Empty tables, null texts and ids, repeated rows and clashing names go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.limit(2).unionByName(docs.selectExpr("null as doc_id", "text", "lang", "null as source", "n_chars").limit(1)).unionByName(docs.selectExpr("doc_id", "null as text", "lang", "source", "n_chars").limit(1))
    for table in (docs.limit(0), docs.unionByName(odd).selectExpr("*", "1 as _row", "'x' as Size", "2 as _n")):
        for _, work in corpus_pipeline.STAGES[:-1]:
            columns = table.columns
            table = corpus_pipeline.written(work(spark, table, SF), "test")
            assert table.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_labels_of_clean_documents_survive_the_filters(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality_rules.keep_documents(docs).select("doc_id", "n_chars").join(labels, "doc_id")
    clean = docs.join(labels.where("quality = 1"), "doc_id")
    n = clean.count()
    assert kept.where("quality = 1").count() > 0.9 * n
