"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document: `ledger` stores what was measured and one failure bit per rule. A policy is a versioned
set of bits; applying another policy, or asking what each rule rejects alone, reads the ledger and never the texts again.

Defined results: a null or empty text has no words, so it measures 0 everywhere and fails `too_few_words`. Repeated rows are
measured alike. Other columns pass through; an input column with the name of a result column, in any case of letters, is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.llm.shared import BLANKS, pack, quoted, unpack

SYMBOLS = "#*$%&|<>"

#: The rules in the order of their bits. All are integer comparisons of measurements, so that no rounding decides.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "100 * n_symbols > 10 * word_chars",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines",
    "upper_case": "100 * n_upper > 50 * word_chars",
    "word_length": "word_chars < 2 * n_words or word_chars > 25 * n_words",
    "shouting": "100 * n_shouts > 10 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, name in enumerate(RULES) if name in self.rules)


BASE = Policy(1, ("too_few_words", "repeated_windows"))
STRICT = Policy(2, tuple(RULES))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts")


def _kept(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES as longs. Windows of three words are compared by their 64-bit hashes, sorted within the row."""
    own, row = pack(df, (*MEASURES, "fail_bits"))
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    # Level by level, so that each array is computed once and then reused.
    level = df.select(*row, body.alias("_t"))
    row = ["_row"] if row else []
    level = level.select(
        *row,
        "_t",
        F.array_remove(F.split("_t", "[\\x20\\x09-\\x0D]+"), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_l"),
    )
    level = level.select(
        *row,
        "_t",
        "_l",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        _kept(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.expr("length(_t) - length(regexp_replace(_t, '\\\\p{Lu}+', ''))").cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit("!![\\x20\\x09-\\x0D]")).cast("long").alias("n_shouts"),
        F.expr(
            "case when size(_w) < 4 then array() else array_sort(transform(sequence(0, size(_w) - 3), i -> "
            "named_struct('h', xxhash64(_w[i], _w[i + 1], _w[i + 2]), 'i', i))) end"
        ).alias("_s"),
    )
    level = level.select(
        *[c for c in level.columns if c != "_s"],
        # Windows that equal a neighbour in the sorted order occur twice or more; each covers three word positions.
        F.expr(
            "size(array_distinct(flatten(transform(filter(transform(_s, (x, j) -> if((j > 0 and _s[j - 1].h = x.h) or "
            "(j + 1 < size(_s) and _s[j + 1].h = x.h), x.i, -1)), p -> p >= 0), p -> array(p, p + 1, p + 2)))))"
        )
        .cast("long")
        .alias("n_repeat_words"),
    )
    level = level.withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    return level.select(*unpack(own), *MEASURES)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """MEASURES and fail_bits, in which bit i is set when rule i of RULES fails."""
    measured = measure(df, text)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("fail_bits", total.cast("long"))


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds policy_version and kept to a ledger."""
    return entries.withColumn("policy_version", F.lit(policy.version)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it rejects, and that all the others would keep.
    The ledger is first summed by its bit patterns (at most 2 to the number of rules), so nothing large is shuffled."""
    masked = entries.select(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = [(name, 1 << i) for i, name in enumerate(RULES) if name in policy.rules]
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in rules]))
    rows = masked.select("bits", "n", stacked.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep_documents(df: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows that the policy keeps, with the columns of df."""
    own, row = pack(df)
    entries = apply_policy(ledger(df.select(F.col("text").alias("_text"), F.struct(*row).alias("_all")), "_text"), policy)
    # The optimizer would copy the whole ledger into the filter once per use; it doesn't move a filter below a row number.
    kept = entries.withColumn("_n", F.monotonically_increasing_id()).where("kept and _n >= 0")
    return kept.select(F.col("_all")["_row"].alias("_row")).select(*unpack(own))
