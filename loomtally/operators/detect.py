"""File to language: broadcast lookups by name, then by extension, and the filters on languages and extensions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions.languages import LANGUAGES, first_claims
from loomtally.functions.scalars import extension, file_name


def registry_frame(spark: SparkSession) -> DataFrame:
    """One row per language: lang_id, lang, aliases, exts, filenames. Its size is fixed by the registry."""
    rows = [(lang.id, lang.name, list(lang.aliases), list(lang.exts), list(lang.filenames)) for lang in LANGUAGES]
    return spark.createDataFrame(rows, "lang_id int, lang string, aliases array<string>, exts array<string>, filenames array<string>")


def lookup_frame(spark: SparkSession, keys: str) -> DataFrame:
    """(key, lang_id) of `exts` or `filenames`, lower-cased; the first language has a key that several claim."""
    exploded = registry_frame(spark).select(F.explode(keys).alias("key"), "lang_id").withColumn("key", F.lower("key"))
    return exploded.groupBy("key").agg(F.min("lang_id").alias("lang_id"))


def detect_language(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds name, ext, lang_id, lang and label: by exact lower-cased file name first, by extension otherwise. An unknown file has a null lang,
    and its upper-cased extension, or Other, for a label. Both lookups are broadcast: the registry is fixed data."""
    spark = files.sparkSession
    by_name = spark.createDataFrame(first_claims("filenames"), "_name string, _id_name int")
    by_ext = spark.createDataFrame(first_claims("exts"), "_ext string, _id_ext int")
    names = spark.createDataFrame([(lang.id, lang.name) for lang in LANGUAGES], "lang_id int, lang string")
    out = files.withColumn("name", file_name(F.col(path))).withColumn("ext", extension(F.col(path)))
    out = out.join(F.broadcast(by_name), F.lower("name") == F.col("_name"), "left").join(F.broadcast(by_ext), F.col("ext") == F.col("_ext"), "left")
    out = out.withColumn("lang_id", F.coalesce("_id_name", "_id_ext")).drop("_name", "_id_name", "_ext", "_id_ext")
    out = out.join(F.broadcast(names), "lang_id", "left")
    return out.withColumn("label", F.coalesce("lang", F.upper("ext"), F.lit("Other")))


def ignored_languages(ignore: Iterable[str]) -> list[int]:
    """Ids of the languages whose name, an alias or an extension is listed; case counts."""
    listed = set(ignore)
    return [lang.id for lang in LANGUAGES if listed & {lang.name, *lang.aliases, *lang.exts}]


def language_allowed(ignore: Iterable[str], lang_id: str = "lang_id", ext: str = "ext") -> Column:
    """Neither the language nor the file's own extension is ignored."""
    listed = sorted(set(ignore))
    ids = ignored_languages(listed)
    by_language = F.coalesce(~F.col(lang_id).isin(ids), F.lit(True)) if ids else F.lit(True)
    by_ext = F.coalesce(~F.col(ext).isin(listed), F.lit(True)) if listed else F.lit(True)
    return by_language & by_ext


def extension_included(only: Iterable[str], lang_id: str = "lang_id", ext: str = "ext") -> Column:
    """With extensions listed, those only; a file without one passes if its language owns one of them. Without a list, known languages only."""
    listed = sorted({e.lower().lstrip(".") for e in only})
    if not listed:
        return F.col(lang_id).isNotNull()
    owners = [lang.id for lang in LANGUAGES if set(listed) & {e.lower() for e in lang.exts}]
    return F.when(F.col(ext).isNotNull(), F.col(ext).isin(listed)).otherwise(F.coalesce(F.col(lang_id).isin(owners), F.lit(False)) if owners else F.lit(False))


def directory_allowed(ignore_dirs: Iterable[str], path: str = "path") -> Column:
    """No directory of the relative path, nor the file's own name, is in the list, whatever its case."""
    listed = sorted({d.lower() for d in ignore_dirs})
    if not listed:
        return F.lit(True)
    return ~F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, listed)))
