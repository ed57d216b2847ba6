"""A quality classifier by positive-unlabelled learning.

Each whole text is measured once into a fixed number of features: counts of its surface, and the shares of its words in BUCKETS hash buckets. A
linear model g of the standardised features is fitted by minimising the non-negative unbiased risk (Kiryo et al., 2017)
pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]) with the logistic loss, so that the sigmoid of g is a probability. P are the trusted
positives and U all training documents, taken without their labels. Labels, lang, source and doc_id are never inputs of a score.

pi, the class prior, is estimated from scores alone (best bin estimation; Garg et al., 2021): a first model tells P from U, and pi is the least ratio
of the shares of U and of P above a threshold, where both are sure enough. The first model is fitted on one half of the rows and the ratio taken from the other. Labels of negatives are never read.

Both fits are Newton steps. Each is one pass over the stored features of all training rows; a pass returns sums whose number depends on the number
of features only, so nothing is sampled and the driver holds no rows. The logistic loss makes the unbiased risk convex; a step that
makes the risk larger is halved.

Defined results: null and empty texts have zeros for features and get a score like any other; equal texts have equal scores; repeated
labels of a document must agree to count as trusted; without trusted positives in each half every score is 0.5, and `keep_good` keeps every row;
empty tables give empty results; extra columns pass through unless they clash with a result column, in any case of letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.llm import textscan
from loomtally.llm.shared import held_out, pack, quoted, remove, scratch_since, unpack, written

THRESHOLD = 0.7
STEPS = 16
#: Weight of the squared weights, and what is added to it over the number of positives.
RIDGE, RIDGE_SMALL = 5e-3, 10.0
#: Bins of the scores from which the prior is estimated, and the probability that a share is further from the truth than allowed for.
BINS = 1024
DELTA = 0.1
FEATURES = (
    "log_words", "word_bytes", "upper", "symbols", "bang", "bar", "digit", "stop", "comma", "newline", "distinct", "echo", "windows", "other_ascii", "accented", "line_words", "lines_repeated", "long_words",
)
#: Hash buckets of words.
BUCKETS = 30
PRIOR_WORDS = 300.0
WIDTH = len(FEATURES) + BUCKETS
CLIP = 6.0


def _share(table: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(table[data], out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(characters)] = 1
    return out


def _repeats(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many entries occur for the first time, and how many in all."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=rows).astype(np.float64), np.bincount(r, minlength=rows).astype(np.float64)


def text_features(texts: pa.Array) -> np.ndarray:
    out = [np.zeros((0, WIDTH))]
    for _, _, data, bounds in textscan.windows(texts, 1 << 20):
        rows = len(bounds) - 1
        starts, ends, firsts = textscan.find_words(data, bounds)
        hashes = textscan.hash_words(data, starts, ends)
        words = np.diff(firsts).astype(np.float64)
        row = np.repeat(np.arange(rows), np.diff(firsts))
        n, size = np.maximum(words, 1), ends - starts
        body = np.maximum(np.bincount(row, size, rows), 1)
        per = {c: _share(_table(t), data, bounds) for c, t in {
            "upper": bytes(range(65, 91)), "symbols": b"#*$%&|<>", "bang": b"!?", "bar": b"|", "digit": b"0123456789", "stop": b".", "comma": b",;:", "newline": b"\n",
            "other_ascii": b"\"'()+-/=@[\\]^_`{}~", "accented": bytes(range(195, 256)),
        }.items()}
        first, _ = _repeats(hashes, row, rows)
        same = np.zeros(len(hashes), np.float64)
        if len(hashes) > 1:
            same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        tri = np.zeros(0, np.uint64)
        if len(hashes) > 2:
            tri = textscan.mix(textscan.mix(hashes[:-2] + np.uint64(7)) * np.uint64(3) + textscan.mix(hashes[1:-1]) * np.uint64(5) + hashes[2:])
        inside = row[2:] == row[:-2] if len(hashes) > 2 else np.zeros(0, bool)
        tri_row = row[:-2][inside] if len(hashes) > 2 else np.zeros(0, np.int64)
        once, every = _repeats(tri[inside], tri_row, rows)
        # Lines as words of their own: their hashes, without the empty ones.
        cuts = np.flatnonzero(data == 10)
        line_at = np.union1d(cuts + 1, bounds[:-1])
        line_at = line_at[line_at < len(data)]
        line_end = np.append(line_at[1:], len(data)) if len(line_at) else line_at
        line_end = np.where((line_end > 0) & np.isin(line_end - 1, cuts), line_end - 1, line_end)
        some = line_end > line_at
        line_hash = textscan.hash_words(data, line_at[some], line_end[some])
        line_row = np.searchsorted(bounds, line_at[some], "right") - 1
        lines_once, lines = _repeats(line_hash, line_row, rows)
        f = np.stack([
            np.log1p(words) / 5, body / n / 8, per["upper"] / body, per["symbols"] / n, per["bang"] / n, per["bar"] / n, per["digit"] / body, per["stop"] / n, per["comma"] / n, per["newline"] / n,
            first / n, np.bincount(row, same, rows) / n, 1 - once / np.maximum(every, 1) * (every > 0), per["other_ascii"] / body, per["accented"] / body,
            np.log1p(n / np.maximum(lines, 1)) / 5, 1 - lines_once / np.maximum(lines, 1) * (lines > 0), np.bincount(row, size > 20, rows) / n,
        ], axis=1)
        spread = np.bincount(row * BUCKETS + (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
        # Shares of few words are drawn towards those of words dealt evenly.
        f = np.concatenate([f, (spread + PRIOR_WORDS / BUCKETS) / (n + PRIOR_WORDS)[:, None]], axis=1)
        f[words == 0] = 0
        out.append(f)
    return np.concatenate(out)


@dataclass
class Model:
    """A linear model of standardised, clipped features; its size does not depend on the data. weights: one a feature, then the constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def inputs(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def value(self, f: np.ndarray) -> np.ndarray:
        return self.inputs(f) @ self.weights

    def score(self, features: Column) -> Column:
        """The sigmoid as an expression over the array of features."""
        z = [(features[k].cast("double") - F.lit(float(self.mean[k]))) / F.lit(float(self.scale[k])) for k in range(len(self.mean))]
        terms = [F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x)) * F.lit(float(w)) for x, w in zip(z, self.weights, strict=False)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return 1 / (1 + F.exp(-(total + F.lit(float(self.weights[-1])))))


def measured(df: DataFrame, text: str = "text", added: tuple[str, ...] = (), keep_text: bool = False) -> tuple[DataFrame, list[str]]:
    """The columns of df that do not clash with added, packed as _row, and _f, an array of WIDTH numbers; and the names of those columns. Written to
    the shared folder, so that each text is measured once."""
    own, row = pack(df, added if keep_text else (*added, text))
    texts = df.select(*row, F.col(quoted(text)).cast("string").alias("_text"))
    schema = T.StructType([*texts.schema.fields[:-1], T.StructField("_f", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = text_features(batch.column(batch.num_columns - 1)).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], schema.names)
            textscan.trim()

    return written(texts.mapInArrow(run, schema), "features"), own


def sums(table: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows (_f, _p) of table of the numbers that `of` gives for a block of rows: partial sums in each task, then one shuffle of a row
    a number and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            f = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
            p = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for k in range(0, len(f), 4096):
                part = of(f[k : k + 4096], p[k : k + 4096])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])
        textscan.trim()

    got = table.select("_f", "_p").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(got.num_rows)
    out[got["k"].to_numpy()] = got["v"].to_numpy()
    return out


def log1pexp(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def _newton(total: Callable, model: Model, prior: float | None) -> Model:
    """With a prior, the non-negative risk; without, the logistic risk of telling P from U. total: sums over the training table."""
    size = WIDTH + 1

    def state(f: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Counts, losses, gradients and the curvature at the weights."""
        z = model.inputs(f)
        g = z @ model.weights
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        curve = (z * (s * (1 - s))[:, None]).T @ z
        mine = z[p]
        also = (mine * (s[p] * (1 - s[p]))[:, None]).T @ mine
        # The losses of calling U negative, P negative and P positive; their gradients in the weights.
        return np.concatenate([[len(f), p.sum(), log1pexp(g).sum(), log1pexp(g[p]).sum(), log1pexp(-g[p]).sum()], z.T @ s, mine.T @ s[p], mine.sum(0), curve.ravel(), also.ravel()])

    best, risk, step = None, np.inf, None
    for _ in range(STEPS):
        got = total(state)
        nu, np_, u_neg, p_neg, p_pos = got[:5]
        gu, gp, zp = got[5:].reshape(-1)[: 3 * size].reshape(3, size)
        curve, also = got[5 + 3 * size :].reshape(2, size, size)
        ridge = (RIDGE + RIDGE_SMALL / np_) * np.append(np.ones(WIDTH), 0)
        penalty = (ridge * model.weights**2).sum() / 2
        # Each part: a value, its slope and its curvature. The risk to lower is the greatest of the parts.
        if prior is None:
            parts = [(p_pos / np_ + u_neg / nu, (gp - zp) / np_ + gu / nu, also / np_ + curve / nu)]
        else:
            # Clamped or not, the risk is convex: max(pi E_P[l(g)], E_U[l(-g)] - pi E_P[g]).
            parts = [
                (prior * p_pos / np_, prior * (gp - zp) / np_, prior * also / np_),
                (prior * (p_pos - p_neg) / np_ + u_neg / nu, gu / nu - prior * zp / np_, curve / nu),
            ]
        now = max(value for value, _, _ in parts) + penalty
        if best is not None and now > risk:
            step = step / 2
            model.weights = best + step
            continue
        done = risk - now < 1e-6
        best, risk = model.weights, now
        if done:
            break
        # The step that lowers the greatest of the parts' quadratic models: the best mixture of the parts, by its lower bound.
        least = -np.inf
        for share in np.linspace(0, 1, 33) if len(parts) > 1 else [1.0]:
            value, slope, bend = (share * x + (1 - share) * y for x, y in zip(parts[0], parts[-1], strict=True))
            slope = slope + ridge * best
            move = -np.linalg.solve(bend + np.diag(ridge + 1e-9), slope)
            if value + slope @ move / 2 > least:
                least, step = value + slope @ move / 2, move
        step *= min(1.0, 10 / max(1e-9, np.abs(step).max()))
        model.weights = best + step
    model.weights = best
    return model


def estimated_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The class prior from counts per score bin, lowest scores first."""
    nu, n = unlabelled.sum(), positive.sum()
    above_u, above_p = unlabelled[::-1].cumsum()[::-1] / nu, positive[::-1].cumsum()[::-1] / n
    known = above_p > 0
    error = np.sqrt(np.log(4 / DELTA) / 2) * (1 / np.sqrt(nu) + 1 / np.sqrt(n))
    ratio = above_u[known] / above_p[known]
    return float(min(1.0, ratio[np.argmin(ratio + error / above_p[known])]))


def _half(f: np.ndarray) -> np.ndarray:
    """Which rows are in the first half; equal features are in one half."""
    numbers = np.ascontiguousarray(f, np.float32).view(np.uint32).astype(np.uint64)
    return (textscan.mix((numbers * (2 * np.arange(WIDTH, dtype=np.uint64) + np.uint64(1))).sum(axis=1)) & np.uint64(1)) == 0


def train(table: DataFrame) -> tuple[Model | None, float]:
    """The model and the prior from a table of _f and _p (whether it is a trusted positive); no model without positives."""
    total = lambda of: sums(table, of)
    got = total(lambda f, p: np.concatenate([[len(f), p.sum()], f.sum(0), (f * f).sum(0)]))
    halves = total(lambda f, p: np.array([p.sum(), p[_half(f)].sum()], np.float64))
    if not len(got) or not 0 < halves[1] < halves[0]:
        return None, 0.5
    mean = got[2 : 2 + WIDTH] / got[0]
    scale = np.sqrt(np.maximum(0, got[2 + WIDTH :] / got[0] - mean**2)) + 1e-3
    # The prior is estimated from rows that the first model has not seen, nor any equal ones.
    first = _newton(lambda of: total(lambda f, p: of(f[h := _half(f)], p[h])), Model(mean, scale, np.zeros(WIDTH + 1)), None)

    def bins(f: np.ndarray, p: np.ndarray) -> np.ndarray:
        f, p = f[h := ~_half(f)], p[h]
        at = np.minimum(BINS - 1, BINS / (1 + np.exp(-np.clip(first.value(f), -40, 40)))).astype(np.int64)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[p], minlength=BINS)]).astype(np.float64)

    counts = total(bins)
    prior = estimated_prior(counts[:BINS], counts[BINS:])
    return _newton(total, Model(mean, scale, np.zeros(WIDTH + 1)), prior), prior


def training_table(features: DataFrame, key: Column, labels: DataFrame, label_key: str = "doc_id", modulus: int = 4) -> DataFrame:
    """_f and _p of the rows that are not held out. labels: label_key, quality."""
    trusted = labels.where(F.col(label_key).isNotNull() & F.col("quality").isNotNull()).groupBy(label_key)
    trusted = trusted.agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = 1 and q2 = 1").select(F.col(label_key).alias("_key"))
    rows = features.select("_f", key.alias("_id")).where(~held_out(F.col("_id"), modulus))
    joined = rows.join(trusted, rows["_id"] == trusted["_key"], "left")
    return written(joined.select("_f", F.col("_key").isNotNull().alias("_p")), "training")


def _trained(features: DataFrame, key: Column, labels: DataFrame) -> Model | None:
    known = scratch_since([])
    model, _ = train(training_table(features, key, labels))
    remove(features.sparkSession, scratch_since(known))
    return model


def score_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without its text, with held_out, score and predicted."""
    features, own = measured(df, text, ("held_out", "score", "predicted"))
    model = _trained(features, F.col("_row")[key], labels)
    score = F.lit(0.5) if model is None else model.score(F.col("_f"))
    out = features.select("_row", score.alias("score"))
    return out.select(*unpack(own), held_out(F.col("_row")[key], 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows predicted 1, with the columns of df. The model is fitted on df's own rows."""
    features, own = measured(df, text, keep_text=True)
    model = _trained(features, F.col("_row")[key], labels)
    return (features if model is None else features.where(model.score(F.col("_f")) >= THRESHOLD)).select(*unpack(own))
