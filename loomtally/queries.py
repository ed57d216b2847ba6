"""Queries of the engine's own operators, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions import scalars
from loomtally.functions.languages import BY_NAME, GENERIC
from loomtally.functions.lines import MEASURES, line_stats, line_stats_mixed
from loomtally.functions.models import resolve_frame
from loomtally.functions.tokens import CJK_RANGES, approx_tokens
from loomtally.operators import detect, ignore, report
from loomtally.operators.vocab_tokens import bpe_udf, pieces_udf
from loomtally.sources.config import DEFAULTS
from loomtally.sources.tree import union_roots

Query = Callable[[SparkSession, str], DataFrame]
EXTS = ("py", "c", "sql", "lua", "js", "md", "rs", "zzz")
NAMES = {"py": "Python", "c": "C", "sql": "SQL", "lua": "Lua", "js": "JavaScript", "md": "Markdown", "rs": "Rust"}

# The synthetic sources' heads and what a sentence end becomes, by extension.
HEADS = {
    "py": '# head\n"""doc\n\nend"""\n',
    "c": "/* head\n\nend */\n",
    "sql": "-- head\n",
    "lua": "--[[ head\n]]\n",
    "js": "`tpl\n\n`\n",
    "rs": 'let s = r#"\n// x"#;\n',
}
BODIES = {"py": (". ", "\n  # "), "c": (". ", "\n// "), "sql": (", ", "\n  -- "), "lua": (". ", "\n-- "), "js": (". ", "\n // "), "rs": (". ", "\n\n// ")}
IGNORE_FILES = ["*.log\nsrc/src1/\n!src/src1/f1.py\n/BUILD\nf?[0-4]*.c\n", "**/src2/*.[pr]*\nnode_modules/\n"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sources(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """A synthetic source tree with one file per document: doc_id, ext, path, text. With only, every file has that extension."""
    d = _documents(spark, sf_dir).select("doc_id", "text", "source")
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (i % 8 + 1).cast("int")) if only is None else F.lit(only)
    d = d.withColumn("ext", ext)
    folder = F.when(i % 50 == 7, "node_modules/").when(i % 50 == 8, "BUILD/").when(i % 50 == 9, "").otherwise("src/")
    name = F.when(i % 40 == 11, "Makefile").when(i % 40 == 12, ".gitignore").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit("."), F.when(i % 3 == 0, F.upper("ext")).otherwise(F.col("ext"))))
    head, body = F.lit(""), F.col("text")
    for e in HEADS:
        head = F.when(F.col("ext") == e, F.lit(HEADS[e])).otherwise(head)
        body = F.when(F.col("ext") == e, F.replace(F.col("text"), F.lit(BODIES[e][0]), F.lit(BODIES[e][1]))).otherwise(body)
    tail = F.when(i % 2 == 0, "\n").otherwise("")
    nul = F.when(i % 97 == 5, F.lit("\x00")).otherwise("")
    return d.select("doc_id", "ext", F.concat(folder, "source", F.lit("/"), name).alias("path"), F.concat(head, body, tail, nul).alias("text"))


def _q(text: str) -> str:
    """A DuckDB string literal."""
    parts = text.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"


_EXT_SQL = f"[{', '.join(f"'{e}'" for e in EXTS)}][cast(doc_id % 8 as int) + 1]"
SOURCES_SQL = f"""
  select doc_id, ext, (case when doc_id % 50 = 7 then 'node_modules/' when doc_id % 50 = 8 then 'BUILD/' when doc_id % 50 = 9 then '' else 'src/' end)
    || source || '/' || (case when doc_id % 40 = 11 then 'Makefile' when doc_id % 40 = 12 then '.gitignore'
      else 'f' || cast(doc_id as varchar) || '.' || (case when doc_id % 3 = 0 then upper(ext) else ext end) end) as path,
    (case ext {' '.join(f"when '{e}' then {_q(h)}" for e, h in HEADS.items())} else '' end)
    || (case ext {' '.join(f"when '{e}' then replace(text, {_q(a)}, {_q(b)})" for e, (a, b) in BODIES.items())} else text end)
    || (case when doc_id % 2 = 0 then chr(10) else '' end) || (case when doc_id % 97 = 5 then chr(0) else '' end) as text
  from (select *, {_EXT_SQL} as ext from documents)"""

_CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)


def tokens_sql(text: str) -> str:
    low = f"length(regexp_replace({text}, '[^\\x00-\\x7F]', '', 'g'))"
    cjk = f"regexp_replace({text}, '[^{_CJK}]', '', 'g')"
    return f"cast(floor({low} / 4.0 + length({cjk}) + (strlen({text}) - {low} - strlen({cjk})) / 2.0) as bigint)"


def marks_sql(text: str, lexemes: str, strings: str | None, comments: str | None) -> str:
    """A text with its strings and comments replaced by marks; lexemes, strings and comments are RE2 patterns."""
    mark = lambda c: f"(chr({c}) || replace(regexp_replace(x, '[^\\n]+', '', 'g'), chr(10), chr(10) || chr({c})))"
    cases = (f"when regexp_matches(x, '{strings}') then {mark(2)} " if strings else "") + (f"when regexp_matches(x, '{comments}') then {mark(1)} " if comments else "")
    body = last_newline_sql(text)
    return f"case when {text} <> '' then coalesce(array_to_string(list_transform(regexp_extract_all({body}, '{lexemes}'), lambda x: case {cases} else x end), ''), '') end"


def last_newline_sql(text: str) -> str:
    return f"(case when {text} like '%' || chr(10) then left({text}, length({text}) - 1) else {text} end)"


def stats_sql(inner: str, carry: str) -> str:
    """lines, blanks, comments and code over a relation with carry columns and m, the marked text (null for an empty one)."""
    return f"""
  select {carry}, cast(len(ls) as bigint) as lines, cast(len(list_filter(ls, lambda x: not regexp_matches(x, '[^ \\t\\n\\f\\r]'))) as bigint) as blanks,
    cast(len(list_filter(ls, lambda x: regexp_matches(x, '[^ \\t\\n\\f\\r]') and not regexp_matches(x, '[^\\x01 \\t\\n\\f\\r]'))) as bigint) as comments,
    cast(len(list_filter(ls, lambda x: regexp_matches(x, '[^\\x01 \\t\\n\\f\\r]'))) as bigint) as code
  from (select *, case when m is null then [] else string_split(m, chr(10)) end as ls from ({inner}))"""


_DQ, _SQ = r'"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*["\\]?', r"''[^''\\\n]*(?:\\[^\n][^''\\\n]*)*[''\\]?"
_ANY = r"(?:.|\n)"
_LEXEMES = {
    "py": (rf'"""(?:[^\\]|\\{_ANY})*?(?:"""|\\?\z)|' + rf"''''''(?:[^\\]|\\{_ANY})*?(?:''''''|\\?\z)|{_DQ}|{_SQ}|#[^\n]*|" + r'[^"' + r"''#\n]+|" + _ANY, r"""^["'']""", "^#"),
    "c": (rf"{_DQ}|{_SQ}|/\*{_ANY}*?(?:\*/|\z)|//[^\n]*|" + r'[^"' + r"''/\n]+|" + _ANY, r"""^["'']""", r"^(?:/\*|//)"),
    "sql": (rf"{_SQ}|{_DQ}|/\*{_ANY}*?(?:\*/|\z)|--[^\n]*|" + r'[^"' + r"''/\-\n]+|" + _ANY, r"""^["'']""", r"^(?:/\*|--)"),
    "lua": (rf"\[\[{_ANY}*?(?:\]\]|\z)|{_DQ}|{_SQ}|--\[\[{_ANY}*?(?:\]\]|\z)|--[^\n]*|" + r'[^"' + r"''\[\-\n]+|" + _ANY, r"""^(?:["'']|\[\[)""", r"^--"),
    "js": (rf"{_DQ}|{_SQ}|`{_ANY}*?(?:`|\z)|/\*{_ANY}*?(?:\*/|\z)|//[^\n]*|" + r'[^"' + r"''`/\n]+|" + _ANY, r"""^["''`]""", r"^(?:/\*|//)"),
    # RE2 has no back-references, so numbers of hashes are spelled out.
    "rs": ("|".join(rf'r{h}"{_ANY}*?(?:"{h}|\z)' for h in ("###", "##", "#")) + rf'|r"|{_DQ}|/\*{_ANY}*?(?:\*/|\z)|//[^\n]*|[^r"/\n]+|' + _ANY, r'^(?:"|r#*")', r"^(?:/\*|//)"),
    "html": (rf"{_DQ}|{_SQ}|<!--{_ANY}*?(?:-->|\z)|" + r'[^"' + r"''<\n]+|" + _ANY, r"""^["'']""", "^<!--"),
}


def _spread(df: DataFrame, stats) -> DataFrame:
    return df.withColumn("_s", stats).select("*", *[F.col(f"_s.{m}").alias(m) for m in MEASURES]).drop("_s")


def approx_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", approx_tokens(F.col("text")).alias("tokens"))


def line_stats_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: tokens and lines by human language with a grand total, in report order."""
    d = _documents(spark, sf_dir).select("lang", "text").withColumn("tokens", approx_tokens(F.col("text")))
    files = _spread(d, line_stats(F.col("text"), BY_NAME["Markdown"].syntax)).drop("text")
    return report.ordered(report.totals(files, "lang"))


def line_stats_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return _spread(pages, line_stats(F.col("html"), BY_NAME["HTML"].syntax)).drop("html")


def _line_stats_of(ext: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = sources(spark, sf_dir, ext).select("doc_id", "text")
        return _spread(files, line_stats(F.col("text"), BY_NAME[NAMES[ext]].syntax)).drop("text")

    return query


def line_stats_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sources(spark, sf_dir, "zzz").select("doc_id", "text")
    return _spread(files, line_stats(F.col("text"), GENERIC)).drop("text")


def line_stats_cpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('auto s = R"x(\n// no )"\n)x";\n'), F.replace("text", F.lit(". "), F.lit("\n// ")))
    files = _documents(spark, sf_dir).select("doc_id", body.alias("text"))
    return _spread(files, line_stats(F.col("text"), BY_NAME["C++"].syntax)).drop("text")


def line_stats_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("/* a /* b */\n still */\n"), F.replace("text", F.lit(". "), F.lit("\n/* x /* y */ */\n")))
    files = _documents(spark, sf_dir).select("doc_id", body.alias("text"))
    return _spread(files, line_stats(F.col("text"), BY_NAME["Swift"].syntax)).drop("text")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_language(sources(spark, sf_dir).select("doc_id", "path", "text"))


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("doc_id", "name", "ext", "lang", "label")


def lang_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine on the synthetic sources: filters, lookups, measures, totals, order."""
    files = _detected(spark, sf_dir)
    keep = detect.extension_included(()) & detect.language_allowed(DEFAULTS.ignore_langs) & detect.directory_allowed(DEFAULTS.ignore_dirs)
    files = files.where(keep & ~scalars.nul_near_start(F.col("text")))
    ids = [BY_NAME[n].id for n in [*NAMES.values(), "Makefile"]]
    measured = _spread(files.withColumn("tokens", approx_tokens(F.col("text"))), line_stats_mixed(F.col("text"), F.col("lang_id"), ids))
    return report.ordered(report.totals(measured, "label"))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_frame(lang_report(spark, sf_dir))


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = report.render(lang_report(spark, sf_dir), "table")
    return spark.createDataFrame(list(enumerate(text.splitlines())), "n int, line string")


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = report.render(lang_report(spark, sf_dir), "md")
    return spark.createDataFrame(list(enumerate(text.splitlines())), "n int, line string")


def ignore_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).where(detect.language_allowed(["py", "Lua", "svg", "zzz"])).select("doc_id", "path")


def only_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).where(detect.extension_included(["PY", "mk", "zzz"])).select("doc_id", "path")


def known_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).where(detect.extension_included([])).select("doc_id", "path", "lang")


def ignore_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).where(detect.directory_allowed(DEFAULTS.ignore_dirs)).select("doc_id", "path")


def vcs_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [ignore.parse_rules(text) for text in IGNORE_FILES]
    return sources(spark, sf_dir).select("doc_id", "path", ignore.skipped_by_any(F.col("path"), files).alias("skip"))


def vcs_ignore_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ignore.rules_frame(spark, [ignore.parse_rules(text) for text in IGNORE_FILES])
    return ignore.skipped_join(sources(spark, sf_dir).select("doc_id", "path"), rules).select("doc_id", "path", "skip")


def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and binary files among them, by extension; the first 8192 characters are looked at, as in the SQL."""
    s = sources(spark, sf_dir).select("ext", scalars.nul_near_start(F.col("text")).alias("b"))
    return s.groupBy("ext").agg(F.count("*").alias("files"), F.count_if("b").alias("binary_files"))


MODEL_INPUTS = ["Claude", "QWEN", "no such model", "DeepSeek-V4", "glm4", "Mixtral", "", "chatgpt"]


def model_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_frame(spark.createDataFrame([(x,) for x in MODEL_INPUTS], "input string"), spark).select("input", "model")


def tokens_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", approx_tokens(F.col("text")).alias("t"))
    return c.groupBy("role").agg(F.count("*").alias("files"), F.sum("t").alias("tokens"))


def tokens_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # Tokens are counted before the join, so no text is shuffled.
    d = _documents(spark, sf_dir).select("doc_id", approx_tokens(F.col("text")).alias("t"))
    return d.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("files"), F.sum("t").alias("tokens"))


def union_roots_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name, column: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.lit(name).alias("root"), approx_tokens(F.col(column)).alias("t"))
    rows = union_roots(read("documents", "text"), read("pages", "html"), read("benchmark", "text"))
    return rows.rollup("root").agg(F.grouping("root").cast("int").alias("is_total"), F.count("*").alias("files"), F.sum("t").alias("tokens"))


def format_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", scalars.thousands(F.col("n_chars") * 1000 + F.col("doc_id")).alias("text"))


def base64_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base64 of whole texts, without padding, decoded again."""
    # Spark may break long codes into lines.
    coded = _documents(spark, sf_dir).select("doc_id", F.regexp_replace(F.base64(F.col("text").cast("binary")), r"[\r\n]+|=+$", "").alias("b64"))
    return coded.select("doc_id", "b64", scalars.base64_bytes(F.col("b64")).cast("string").alias("decoded"))


def paths_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("doc_id", "path").orderBy(F.split("path", "/"), "doc_id")


def byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(0, 300).select("id", F.concat(F.lit("<0x"), F.upper(F.hex(F.col("id"))), F.lit(">")).alias("piece"))
    return rows.select("id", "piece", scalars.byte_piece(F.col("piece")).cast("long").alias("value"))


def hand_made_ranks() -> dict[bytes, int]:
    """A small vocabulary: all bytes, then pairs and triples of common letters, in a fixed order."""
    common = "etaoinshrdlu"
    tokens = [bytes([b]) for b in range(256)]
    tokens += [(a + b).encode() for a in common for b in common] + [(" " + a).encode() for a in common]
    tokens += [(a + b + c).encode() for a in "tain" for b in "hne" for c in "edg"]
    return {t: i for i, t in enumerate(dict.fromkeys(tokens))}


def hand_made_pieces() -> list[tuple[bytes, float, int]]:
    rows = [("<unk>".encode(), -10.0, 2)] + [(f"<0x{b:02X}>".encode(), -9.0, 6) for b in range(256)]
    common = "etaoinshrdlu"
    rows += [(a.encode(), -4.0 - i / 16, 1) for i, a in enumerate(common)] + [("▁".encode(), -3.0, 1)]
    rows += [((p + a + b).encode(), -5.0 - (i + j) / 32, 1) for p in ("", "▁") for i, a in enumerate(common) for j, b in enumerate(common)]
    return rows


def bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", bpe_udf(spark, hand_made_ranks())(F.col("text")).alias("tokens"))


def sp_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", pieces_udf(spark, hand_made_pieces())(F.col("text")).alias("tokens"))


def queries() -> dict[str, Query]:
    own = (
        line_stats_markdown, line_stats_html, line_stats_generic, line_stats_cpp, line_stats_nested, lang_detect, lang_report, report_json, report_table, report_markdown, ignore_lang, only_ext,
        known_only, ignore_dir, vcs_ignore, vcs_ignore_join, binary_sniff, model_resolve, tokens_by_role, tokens_by_label, format_numbers, base64_ranks, paths_sorted, byte_pieces, bpe_tokens, sp_tokens,
    )
    named = {f.__name__: f for f in own} | {"approx_tokens": approx_tokens_query, "union_roots": union_roots_query}
    names = {"py": "python", "rs": "rust"}
    return named | {f"line_stats_{names.get(e, e)}": _line_stats_of(e) for e in NAMES if e != "md"}


def _detected_sql() -> str:
    """Labels of the synthetic sources; written out by hand from their file names and extensions, not taken from the registry."""
    named = " ".join(f"when '{e}' then '{n}'" for e, n in NAMES.items())
    return f"""
  select *, coalesce(lang, upper(ext), 'Other') as label
  from (select *, case when lower(name) = 'makefile' then 'Makefile' else case ext {named} end end as lang
        from (select doc_id, path, text, name, nullif(lower(regexp_extract(name, '^(?s:.+)\\.([^.]+)$', 1)), '') as ext
              from (select doc_id, path, text, string_split(path, '/')[-1] as name from ({SOURCES_SQL}))))"""


def _dirs_sql() -> str:
    listed = ", ".join(f"'{d.lower()}'" for d in DEFAULTS.ignore_dirs)
    return f"not list_has_any(string_split(lower(path), '/'), [{listed}])"


# Each ignore file as SQL, its last line first; written out by hand, not compiled from IGNORE_FILES.
_VCS_SQL = [
    """case when regexp_matches(path, '(^|/)f[^/][0-4][^/]*\\.c(/|$)') then true when regexp_matches(path, '^BUILD(/|$)') then true
      when regexp_matches(path, '^src/src1/f1\\.py(/|$)') then false when starts_with(path, 'src/src1/') then true
      else regexp_matches(path, '(^|/)[^/]*\\.log(/|$)') end""",
    "regexp_matches(path, '(^|/)node_modules/') or regexp_matches(path, '(^|/)src2/[^/]*\\.[pr][^/]*(/|$)')",
]
# What MODEL_INPUTS name, in order; no model: null.
_RESOLVED = ("claude", "qwen", None, "deepseek", "glm", "mistral", None, "chatgpt")


def _report_sql(rolled: str, fmt: str) -> str:
    """The lines of a report as a table or in Markdown, numbered from 0."""
    columns = ("files", *report.MEASURES)
    rank = "row_number() over (order by is_total, code desc, files desc, lang)"
    cells = f"select {rank} as k, is_total, lang as c0, " + ", ".join(f"format('{{:,}}', {c}) as c{i}" for i, c in enumerate(columns, 1)) + f" from ({rolled})"
    heads = ", ".join(f"'{h}' as c{i}" for i, h in enumerate(report.HEADS))
    cells = f"select 0 as k, 0 as is_total, {heads} union all {cells}"
    if fmt == "markdown":
        bold = "case when is_total = 1 then '**' || c0 || '**' else c0 end"
        line = f"'| ' || {bold} || ' | ' || " + " || ' | ' || ".join(f"c{i}" for i in range(1, 7)) + " || ' |'"
        return f"""
  with c as ({cells})
  select cast(case when k = 0 then 0 else k + 1 end as int) as n, {line} as line from c union all select 1, '|{" --- |" * 7}'"""
    widths = ", ".join(f"max(strlen(c{i})) as w{i}" for i in range(7))
    line = "rtrim(rpad(c0, cast(w0 as int), ' ') || " + " || ".join(f"'   ' || lpad(c{i}, cast(w{i} as int), ' ')" for i in range(1, 7)) + ")"
    rule = "repeat('─', cast(" + " + ".join(f"w{i}" for i in range(7)) + " + 18 as int))"
    return f"""
  with c as ({cells}), w as (select {widths}, max(k) as last from c)
  select cast(case when k = 0 then 0 when is_total = 1 then k + 2 else k + 1 end as int) as n, {line} as line from c, w
  union all select cast(unnest([1, last + 1, last + 3]) as int), {rule} from w"""


def _json_sql(rolled: str) -> str:
    names = ("files", *report.MEASURES)
    body = ", ".join(f"'{c}': {c}" for c in names)
    return f"""
  select cast(to_json({{'languages': (list({{'language': lang, {body}}} order by code desc, files desc, lang) filter (where is_total = 0)),
    'total': (first({{{body}}}) filter (where is_total = 1))}}) as varchar) as report from ({rolled})"""


def oracle_sql() -> dict[str, str]:
    out = {"approx_tokens": f"select doc_id, {tokens_sql('text')} as tokens from documents"}
    total = (
        "cast(sum(tokens) as bigint) as tokens, cast(sum(lines) as bigint) as lines, cast(sum(blanks) as bigint) as blanks, cast(sum(comments) as bigint) as comments, cast(sum(code) as bigint) as code"
    )
    rolled = lambda inner, label: (
        f"select case when grouping({label}) = 1 then 'Total' else {label} end as lang, cast(grouping({label}) as int) as is_total, count(*) as files, {total} from ({inner}) group by rollup({label})"
    )
    out["line_stats_markdown"] = rolled(stats_sql(f"select lang, {tokens_sql('text')} as tokens, case when text <> '' then {last_newline_sql('text')} end as m from documents", "lang, tokens"), "lang")
    out["line_stats_html"] = stats_sql(f"select page_id, {marks_sql('html', *_LEXEMES['html'])} as m from pages", "page_id")
    named = {"py": "python", "rs": "rust"}
    every = lambda e: SOURCES_SQL.replace(_EXT_SQL, f"'{e}'")  # noqa: E731  every document as a file of this extension
    for e in HEADS:
        out[f"line_stats_{named.get(e, e)}"] = stats_sql(f"select doc_id, {marks_sql('text', *_LEXEMES[e])} as m from ({every(e)})", "doc_id")
    generic = (rf"{_DQ}|{_SQ}|" + r'[^"' + r"''\n]+|" + _ANY, r"""^["'']""", None)
    out["line_stats_generic"] = stats_sql(f"select doc_id, {marks_sql('text', *generic)} as m from ({every('zzz')})", "doc_id")
    # The text of line_stats_nested has comments two deep at most, that of line_stats_cpp raw strings with one delimiter.
    inner = r"/\*(?:[^*/]|\*+[^*/]|/[^*])*?\*/"
    nested = (rf'"""(?:[^\\]|\\{_ANY})*?(?:"""|\\?\z)|{_DQ}|/\*(?:{inner}|[^*/]|\*[^/]|/[^*])*?(?:\*/|\z)|//[^\n]*|' + r'[^"/\n]+|' + _ANY, '^"', r"^(?:/\*|//)")
    body = "'/* a /* b */' || chr(10) || ' still */' || chr(10) || replace(text, '. ', chr(10) || '/* x /* y */ */' || chr(10))"
    out["line_stats_nested"] = stats_sql(f"select doc_id, {marks_sql('text', *nested)} as m from (select doc_id, {body} as text from documents)", "doc_id")
    raw = (rf'R"x\({_ANY}*?(?:\)x"|\z)|R"|{_DQ}|{_SQ}|/\*{_ANY}*?(?:\*/|\z)|//[^\n]*|' + r'[^R"' + r"''/\n]+|" + _ANY, r"""^(?:R?"|'')""", r"^(?:/\*|//)")
    body = "'auto s = R\"x(' || chr(10) || '// no )\"' || chr(10) || ')x\";' || chr(10) || replace(text, '. ', chr(10) || '// ')"
    out["line_stats_cpp"] = stats_sql(f"select doc_id, {marks_sql('text', *raw)} as m from (select doc_id, {body} as text from documents)", "doc_id")
    detected = _detected_sql()
    out["lang_detect"] = f"select doc_id, name, ext, lang, label from ({detected})"
    make = (rf"{_DQ}|{_SQ}|#[^\n]*|" + r'[^"' + r"''#\n]+|" + _ANY, r"""^["'']""", "^#")
    branches = " ".join(f"when '{NAMES[e]}' then {marks_sql('text', *_LEXEMES[e])}" for e in HEADS) + f" when 'Makefile' then {marks_sql('text', *make)}"
    kept = f"select * from ({detected}) where lang is not null and lang <> 'XML' and coalesce(ext not in ('svg', 'lock', 'map'), true) and {_dirs_sql()} and not contains(left(text, 8192), chr(0))"
    out["lang_report"] = rolled(stats_sql(f"select label, {tokens_sql('text')} as tokens, case lang {branches} else {last_newline_sql('text')} end as m from ({kept})", "label, tokens"), "label")
    out["report_table"], out["report_markdown"] = _report_sql(out["lang_report"], "table"), _report_sql(out["lang_report"], "markdown")
    out["report_json"] = _json_sql(out["lang_report"])
    out["ignore_lang"] = f"select doc_id, path from ({detected}) where coalesce(lang not in ('Python', 'Lua', 'XML'), true) and coalesce(ext not in ('py', 'Lua', 'svg', 'zzz'), true)"
    out["only_ext"] = f"select doc_id, path from ({detected}) where case when ext is not null then ext in ('py', 'mk', 'zzz') else coalesce(lang in ('Python', 'Makefile'), false) end"
    out["known_only"] = f"select doc_id, path, lang from ({detected}) where lang is not null"
    out["ignore_dir"] = f"select doc_id, path from ({SOURCES_SQL}) where {_dirs_sql()}"
    out["vcs_ignore"] = out["vcs_ignore_join"] = f"select doc_id, path, ({') or ('.join(_VCS_SQL)}) as skip from ({SOURCES_SQL})"
    out["binary_sniff"] = f"select ext, count(*) as files, count(*) filter (where contains(left(text, 8192), chr(0))) as binary_files from ({SOURCES_SQL}) group by ext"
    answers = ", ".join(f"('{x}', {'null' if m is None else repr(m)})" for x, m in zip(MODEL_INPUTS, _RESOLVED, strict=True))
    out["model_resolve"] = f"select * from (values {answers}) v(input, model)"
    out["tokens_by_role"] = f"select role, count(*) as files, cast(sum({tokens_sql('text')}) as bigint) as tokens from conversations group by role"
    out["tokens_by_label"] = f"select quality, toxic, count(*) as files, cast(sum({tokens_sql('text')}) as bigint) as tokens from documents join labels using (doc_id) group by quality, toxic"
    roots = " union all ".join(f"select '{n}' as root, {tokens_sql(c)} as t from {n}" for n, c in (("documents", "text"), ("pages", "html"), ("benchmark", "text")))
    out["union_roots"] = f"select root, cast(grouping(root) as int) as is_total, count(*) as files, cast(sum(t) as bigint) as tokens from ({roots}) group by rollup(root)"
    out["format_numbers"] = "select doc_id, format('{:,}', n_chars * 1000 + doc_id) as text from documents"
    out["base64_ranks"] = "select doc_id, rtrim(base64(encode(text)), '=') as b64, text as decoded from documents"
    out["paths_sorted"] = f"select doc_id, path from ({SOURCES_SQL})"
    out["byte_pieces"] = "select id, '<0x' || upper(printf('%X', id)) || '>' as piece, case when id < 256 then id end as value from (select range as id from range(300))"
    return out
