"""Registered queries run over whole tables and whole texts."""

from __future__ import annotations

import base64
import json

import duckdb
import pytest

from loomtally import queries

SF = "/root/testdata/sf0.001"


def test_base64_of_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.base64_ranks(spark, SF).collect()
    assert len(got) == len(texts) and max(map(len, texts.values())) > 10_000
    for r in got:
        assert r.decoded == texts[r.doc_id] and r.b64 == base64.b64encode(texts[r.doc_id].encode()).decode().rstrip("=")


@pytest.mark.parametrize("name", sorted(n for n in queries.oracle_sql() if n.startswith("line_stats") or n == "base64_ranks"))
def test_queries_equal_their_sql_over_every_row(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    rows = sorted(str(tuple(r[c] for c in found.columns)) for r in queries.queries()[name](spark, SF).collect())
    assert rows == sorted(map(str, found.fetchall()))
    if name not in ("line_stats_markdown", "line_stats_html"):
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", ["lang_detect", "lang_report", "report_table", "report_markdown", "report_json", "ignore_lang", "only_ext", "known_only", "vcs_ignore", "vcs_ignore_join", "model_resolve"])
def test_queries_equal_sql_written_by_hand(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    rows = sorted(str(tuple(r[c] for c in found.columns)) for r in queries.queries()[name](spark, SF).collect())
    assert rows == sorted(map(str, found.fetchall()))


def equal_to_sql_with_late_nuls(spark, tmp_path, name) -> list[tuple]:
    """Holds a query against its SQL on texts whose NUL comes just before or after 8192 characters; most have it after 8192 bytes. Gives the rows."""
    rows = []
    for k, (unit, n) in enumerate((u, n) for u in ("a", "é", "€", "𝄞", "e\u0301", ". é") for n in (8100, 8190, 8191, 8192)):
        # Eight neighbours have one extension each; every 97th document gets the NUL.
        rows += [((8 * k + e) * 97 + 5, (unit * n)[:n], "en", f"src{e}", n) for e in range(8)]
        rows.append((9700 * (k + 1), unit * 20, "en", "src9", 20))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    got = [tuple(r[c] for c in found.columns) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, found.fetchall()))
    return got


def test_binary_sniff_counts_characters(spark, tmp_path):
    got = equal_to_sql_with_late_nuls(spark, tmp_path, "binary_sniff")
    assert all(0 < binary < files for _, files, binary in got)


def test_lang_report_counts_characters(spark, tmp_path):
    got = equal_to_sql_with_late_nuls(spark, tmp_path, "lang_report")
    # Unknown and binary files are left out, all others are in.
    assert got[-1][:2] == ("Total", 1) and got[-1][2] == sum(r[2] for r in got[:-1]) > 0


def test_report_json_counts_characters(spark, tmp_path):
    ((report,),) = equal_to_sql_with_late_nuls(spark, tmp_path, "report_json")
    read = json.loads(report)
    assert read["total"]["files"] == sum(r["files"] for r in read["languages"]) > 0


def test_report_markdown_counts_characters(spark, tmp_path):
    got = equal_to_sql_with_late_nuls(spark, tmp_path, "report_markdown")
    assert [n for n, _ in got] == list(range(len(got))) and got[-1][1].startswith("| **Total** |")


def test_report_table_counts_characters(spark, tmp_path):
    got = equal_to_sql_with_late_nuls(spark, tmp_path, "report_table")
    assert [n for n, _ in got] == list(range(len(got))) and got[-2][1].startswith("Total ")


def test_paths_are_in_order(spark):
    paths = [r.path.split("/") for r in queries.paths_sorted(spark, SF).collect()]
    assert paths == sorted(paths)
