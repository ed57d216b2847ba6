"""Totals per language, their order, and the four report formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("tokens", "lines", "blanks", "comments", "code")
# The headings of a report.
HEADS = ("Language", "Files", "Tokens", "Lines", "Blanks", "Comments", "Code")
FORMATS = ("table", "markdown", "json")


def totals(files: DataFrame, label: str = "lang") -> DataFrame:
    """One row per language and one for all (is_total), in a single pass: lang, is_total, files and the sums of MEASURES. Partial sums are
    made before the shuffle, so it carries a row per task and language."""
    rolled = files.select(F.col(label).alias("lang"), *MEASURES).rollup("lang").agg(
        F.grouping("lang").cast("int").alias("is_total"), F.count("*").alias("files"), *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES]
    )
    return rolled.select(F.when(F.col("is_total") == 1, "Total").otherwise(F.col("lang")).alias("lang"), "is_total", "files", *MEASURES)


def ordered(report: DataFrame) -> DataFrame:
    """Code and files descending, then the name; the total last."""
    return report.orderBy("is_total", F.desc("code"), F.desc("files"), F.asc("lang"))


def parse_format(name: str) -> str:
    low = name.strip().lower()
    low = "markdown" if low == "md" else low
    if low not in FORMATS:
        raise ValueError(f"unknown format {name!r}; choose one of {', '.join(FORMATS)}")
    return low


def _collected(report: DataFrame) -> tuple[list[tuple], tuple]:
    """The rows of a report, at most one per language of the registry or extension, and the total."""
    rows = [tuple(r[c] for c in ("lang", "files", *MEASURES)) for r in ordered(report).collect()]
    return (rows[:-1], rows[-1]) if rows else ([], ("Total", *[0] * 6))


def render(report: DataFrame, fmt: str = "table", model: str = "", tool: str = "loomtally", version: str = "0.1.0") -> str:
    rows, total = _collected(report)
    return {"table": render_table, "markdown": render_markdown}[fmt](rows, total) if (fmt := parse_format(fmt)) != "json" else render_json(rows, total, model, tool, version)


def _numbers(row: tuple) -> list[str]:
    return [row[0], *(f"{n:,}" for n in row[1:])]


def render_table(rows: list[tuple], total: tuple) -> str:
    """Aligned columns with a gap of three; widths are in bytes, as a name's bytes, not its characters, are what is counted."""
    cells = [list(HEADS), *map(_numbers, rows), _numbers(("Total", *total[1:]))]
    widths = [max(len(r[i].encode()) for r in cells) for i in range(len(HEADS))]
    line = lambda r: "   ".join([r[0].ljust(widths[0]), *(c.rjust(w) for c, w in zip(r[1:], widths[1:], strict=True))]).rstrip()
    rule = "─" * (sum(widths) + 3 * (len(HEADS) - 1))
    return "\n".join([line(cells[0]), rule, *map(line, cells[1:-1]), rule, line(cells[-1]), rule]) + "\n"


def render_markdown(rows: list[tuple], total: tuple) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    last = [f"**{c}**" if i == 0 else c for i, c in enumerate(_numbers(("Total", *total[1:])))]
    return "\n".join([line(HEADS), line(["---"] * 7), *[line(_numbers(r)) for r in rows], line(last)]) + "\n"


def render_json(rows: list[tuple], total: tuple, model: str, tool: str, version: str) -> str:
    names = ("files", *MEASURES)
    body = {
        "tool": tool,
        "version": version,
        "model": model,
        "languages": [{"language": r[0], **dict(zip(names, r[1:], strict=True))} for r in rows],
        "total": dict(zip(names, total[1:], strict=True)),
    }
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n"


def json_frame(report: DataFrame) -> DataFrame:
    """The report as one JSON string made by Spark, for sinks."""
    fields = ["files", *MEASURES]
    lang = F.struct(F.col("lang").alias("language"), *fields)
    key = F.struct((-F.col("code")).alias("a"), (-F.col("files")).alias("b"), F.col("lang").alias("c"), lang.alias("v"))
    listed = report.groupBy().agg(F.array_sort(F.collect_list(F.when(F.col("is_total") == 0, key))).alias("l"), F.first(F.when(F.col("is_total") == 1, F.struct(*fields)), ignorenulls=True).alias("total"))
    return listed.select(F.to_json(F.struct(F.transform("l", lambda x: x["v"]).alias("languages"), "total")).alias("report"))
