"""The main query: files to a report of totals per language."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions.lines import MEASURES, line_stats_mixed
from loomtally.functions.models import resolve
from loomtally.functions.tokens import approx_tokens
from loomtally.operators.detect import detect_language, directory_allowed, extension_included, language_allowed
from loomtally.operators.report import ordered, parse_format, render, totals
from loomtally.operators.vocab_tokens import bpe_udf, pieces_udf
from loomtally.sources.config import DEFAULTS, Options
from loomtally.sources.tree import Repositories, list_files, paths_frame, read_contents
from loomtally.sources.vocab import choose_tokenizer


def wanted(files: DataFrame, options: Options) -> DataFrame:
    """Detected files that no filter on names drops."""
    found = detect_language(files)
    keep = extension_included(options.exts) & language_allowed(options.ignore_langs) & directory_allowed(options.ignore_dirs)
    return found.where(keep).withColumn("lang_id", F.coalesce("lang_id", F.lit(-1)))


def token_column(spark: SparkSession, text: Column, options: Options, **choice) -> Column:
    model = resolve(options.model)
    if model is None:
        raise ValueError(f"unknown model {options.model!r}")
    kind, vocabulary = choose_tokenizer(model, options.tokenizer_dir, **choice)
    if kind == "bpe":
        return bpe_udf(spark, vocabulary)(text)
    if kind == "sentencepiece":
        return pieces_udf(spark, vocabulary)(text)
    return approx_tokens(text)


def measured(files: DataFrame, tokens: Column, ids: list[int] | None = None, text: str = "text") -> DataFrame:
    """Adds tokens and MEASURES of the column text, by lang_id."""
    stats = files.withColumn("tokens", tokens).withColumn("_s", line_stats_mixed(F.col(text), F.col("lang_id"), ids))
    return stats.select("*", *[F.col(f"_s.{m}").alias(m) for m in MEASURES]).drop("_s")


def count_table(table: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The report of a table with path and text; rows with a NUL near their start are binary and left out."""
    spark = table.sparkSession
    from loomtally.sources.tree import from_table

    files = wanted(from_table(table), options).where("not is_binary")
    return ordered(totals(measured(files, token_column(spark, F.col("text"), options)), "label"))


def count_paths(spark: SparkSession, roots: Iterable[str], options: Options = DEFAULTS) -> DataFrame:
    """The report of directory trees. Lines are classified on Latin-1 characters, one per byte, as all marks are ASCII."""
    roots = list(roots)
    paths = list_files(roots, options.ignore_dirs, Repositories(roots) if options.use_vcs else None)
    # The lister has pruned directories below the roots; the roots' own names do not count.
    files = wanted(paths_frame(spark, paths, options.partitions), Options(exts=options.exts, ignore_langs=options.ignore_langs))
    contents = read_contents(files.select("path", "lang_id", "label")).where("not is_binary")
    model = resolve(options.model)
    if model is None:
        raise ValueError(f"unknown model {options.model!r}")
    kind, _ = choose_tokenizer(model, options.tokenizer_dir)
    from loomtally.functions.tokens import approx_tokens_binary

    tokens = approx_tokens_binary(F.col("content")) if kind == "approx" else token_column(spark, F.col("content"), options)
    contents = contents.withColumn("text", F.decode("content", "ISO-8859-1"))
    return ordered(totals(measured(contents, tokens), "label"))


def count(spark: SparkSession, roots: Iterable[str], options: Options = DEFAULTS) -> str:
    """The rendered report of directory trees; empty if there are no files."""
    fmt, model = parse_format(options.format), resolve(options.model)
    report = count_paths(spark, roots, options)
    rows = report.collect()
    if not rows:
        return ""
    return render(spark.createDataFrame(rows, report.schema), fmt, model.name if model else options.model)


def diagnostics(spark: SparkSession, roots: Iterable[str], options: Options = DEFAULTS) -> list[str]:
    """What a verbose run tells: repositories and their rules, files that are listed, wanted, binary or can't be read, and the tokenizer."""
    roots = list(roots)
    repositories = Repositories(roots) if options.use_vcs else None
    paths = list_files(roots, options.ignore_dirs, repositories)
    files = wanted(paths_frame(spark, paths, options.partitions), Options(exts=options.exts, ignore_langs=options.ignore_langs))
    chosen = files.count()
    read = {r.is_binary: r["count"] for r in read_contents(files.select("path")).groupBy("is_binary").count().collect()}
    model = resolve(options.model)
    kind = choose_tokenizer(model, options.tokenizer_dir)[0] if model else "none"
    return [
        f"repository rules: {'read' if repositories else 'not used'}",
        f"files listed: {len(paths)}",
        f"files of wanted languages: {chosen}",
        f"binary files skipped: {read.get(True, 0)}",
        f"files that could not be read: {chosen - sum(read.values())}",
        f"model: {model.name if model else options.model}, tokens by {kind}",
    ]
