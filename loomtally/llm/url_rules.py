"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains when the url's path starts with the rule's. The canonical key of a
rule is its host with the labels reversed, a separator below all other characters, and its path: every url that the rule fits
under one of its own host suffixes has a key in the interval from that key to its last extension. Intervals of prefixes nest or
are disjoint. Urls (one probe per host suffix) and interval ends are range-partitioned and sorted together, and a running window
carries the top of the stack of open intervals: a start pushes its rule, an end pops back to the rule that encloses it, which each
rule learns beforehand from the rules that are prefixes of its own key.

Defined results: the rule with the longest key wins, then the one with the longer host; a null url or one without `://` has an empty host and path and
matches nothing; no rule gives the default verdict and a null rule; of repeated rules the lowest verdict stays; rows with equal
urls or repeated rows are judged alike; a rule with a null host or path fits nothing; an empty table gives an empty result; extra columns pass
through unless they clash with a result column, in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtally.llm.shared import pack, quoted, unpack, written

DEFAULT_VERDICT = "allow"
#: Between host and path, and left in no host; above every byte of UTF-8 text.
LOW, HIGH = "\x01", b"\xff"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(after, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _reversed_labels(host: Column) -> Column:
    """The labels, last first; LOW and the character after it are spelled with two others."""
    spelled = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x03")), F.lit(LOW), F.lit("\x02\x04"))
    return F.reverse(F.split(spelled, r"\."))


def rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(_reversed_labels(host), "."), F.lit(LOW), path)


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT, partitions: int | None = None) -> DataFrame:
    """df with host, path, rule and verdict. rules: host, path, verdict."""
    spark = df.sparkSession
    added = ("host", "path", "rule", "verdict")
    own, row = pack(df, (*added, url))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = df.select(*row, host_of(F.col(quoted(url))).alias("host"), path_of(F.col(quoted(url))).alias("path"))

    keyed = rules.select("host", "path", "verdict").where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    keyed = keyed.select(rule_key(F.col("host"), F.col("path")).alias("lo"), F.concat("host", "path").alias("name"), F.length("host").alias("hl"), "verdict")
    # What encloses a rule is the longest other rule that its key starts with: equi-joins on the prefixes of its own key.
    prefixes = keyed.select("lo", F.explode(F.expr("transform(sequence(1, length(lo) - 1), i -> substring(lo, 1, i))")).alias("p"))
    outer = keyed.select(F.col("lo").alias("p"), F.struct(F.length("lo").alias("l"), F.col("hl").alias("h"), F.col("name").alias("n"), F.col("verdict").alias("v")).alias("o"))
    parents = prefixes.join(outer, "p").groupBy("lo").agg(F.max("o").alias("above"))
    state = F.struct(F.length("lo").alias("l"), F.col("hl").alias("h"), F.col("name").alias("n"), F.col("verdict").alias("v"))
    known = keyed.join(parents, "lo", "left").select("lo", state.alias("own"), "above")
    none = F.struct(F.lit(-1).alias("l"), F.lit(-1).alias("h"), F.lit(None).cast("string").alias("n"), F.lit(None).cast("string").alias("v"))
    ends = known.select(
        F.explode(
            F.array(
                F.struct(F.col("lo").cast("binary").alias("key"), F.length("lo").alias("kind"), F.col("own").alias("top")),
                # Of intervals that end together the inner ones, which have longer keys, close first.
                F.struct(F.concat(F.col("lo").cast("binary"), F.lit(HIGH)).alias("key"), (-F.length("lo")).alias("kind"), F.coalesce("above", none).alias("top")),
            )
        ).alias("e")
    ).select("e.key", "e.kind", "e.top")

    # One probe per host suffix: host a.b.c asks at c, b.c and a.b.c.
    labels = pages.select(F.xxhash64("host", "path").alias("_salt"), "host", "path").distinct().withColumn("_l", _reversed_labels(F.col("host")))
    probes = labels.where("host <> ''").select(
        "host", "path", F.explode(F.expr(f"transform(sequence(1, size(_l)), i -> concat(array_join(slice(_l, 1, i), '.'), '{LOW}', path))")).alias("key")
    )
    probes = probes.select(F.col("key").cast("binary").alias("key"), F.lit(1 << 30).alias("kind"), F.lit(None).cast(ends.schema["top"].dataType).alias("top"), "host", "path")
    events = probes.unionByName(ends, allowMissingColumns=True)
    swept = events.repartitionByRange(n, "key", "kind", F.xxhash64("host", "path")).withColumn("part", F.spark_partition_id())
    swept = written(swept, "sweep")
    # The stack's top at the start of a part is the last one seen in the parts before it: a row per part.
    lasts = swept.where("top is not null").groupBy("part").agg(F.max_by("top", F.struct("key", "kind")).alias("last"))
    starts = spark.range(n).select(F.col("id").cast("int").alias("part")).join(lasts, "part", "left")
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("part", carried.alias("carry"))
    running = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = swept.withColumn("t", F.last("top", ignorenulls=True).over(running)).where("host is not null")
    # n rows at most: as many as there are partitions.
    found = found.join(F.broadcast(starts), "part").select("host", "path", F.coalesce("t", "carry").alias("t")).where("t.n is not null")
    best = found.groupBy("host", "path").agg(F.max("t").alias("t"))
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select(*unpack(own), "host", "path", F.col("t.n").alias("rule"), F.coalesce("t.v", F.lit(default)).alias("verdict"))
