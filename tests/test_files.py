"""Names, ignore rules, listing, vocabulary files, options and reports."""

from __future__ import annotations

import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from loomtally import cli
from loomtally.functions.models import MODELS, resolve
from loomtally.functions.scalars import base64_bytes, byte_piece, extension, file_name, looks_binary, thousands
from loomtally.operators import detect, ignore, report
from loomtally.plans.count import count, count_paths, diagnostics
from loomtally.sources import config, vocab
from loomtally.sources.config import Options
from loomtally.sources.tree import Repositories, list_files, paths_frame, read_contents


def column(spark, values, function, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(function(F.col("v"))).collect()]


def test_scalars(spark):
    paths = ["a/b.RS", "a/.gitignore", "x.", "noext", "a.b/c", "d/e.tar.gz", None]
    assert column(spark, paths, extension) == ["rs", None, None, None, None, "gz", None]
    assert column(spark, ["a/b.RS", "c"], file_name) == ["b.RS", "c"]
    assert column(spark, [0, 999, 1234567], thousands, "long") == ["0", "999", "1,234,567"]
    assert column(spark, ["aGVsbG8=", "aGVs bG8", "a!b=", ""], base64_bytes) == [b"hello", b"hello", None, b""]
    assert column(spark, ["<0xAB>", "<0x1>", "x", None], byte_piece) == [171, 1, None, None]
    data = [bytearray(b"a\x00"), bytearray(b"a" * 8192 + b"\x00"), bytearray()]
    assert column(spark, data, looks_binary, "binary") == [True, False, False]


def test_detection(spark):
    rows = ["src/Makefile", "a.S", "b.PY", "c.zzz", "LICENSE", "x/CMakeLists.txt", "d.svg", "e.h", ".bashrc", "bashrc"]
    got = {r.path: r.label for r in detect.detect_language(spark.createDataFrame([(p,) for p in rows], "path string")).collect()}
    assert [got[p] for p in rows] == ["Makefile", "Assembly", "Python", "ZZZ", "Other", "CMake", "XML", "C", "Other", "Bash"]
    assert {r.key: r.lang_id for r in detect.lookup_frame(spark, "exts").collect()} == dict(detect.first_claims("exts"))
    assert 20 in detect.ignored_languages(["svg"]) and detect.ignored_languages(["Svg"]) == []


MATCHES = [("*.log", "a.log", True), ("*.log", "d/a.log", True), ("/a", "d/a", False), ("/a", "a/x", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("foo/**", "foo", True),
           ("f?o", "foo", True), ("f?o", "fo", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[", "[", True), ("d/", "d", False), ("d/", "d/x", True), ("**", "a/b", True)]


def test_ignore_rules(spark):
    assert ignore.parse_line("  # no") is not None and ignore.parse_line("# no") is None and ignore.parse_line("   ") is None
    assert ignore.parse_line("!keep/") == ignore.Rule(True, True, False, ("keep",))
    assert ignore.parse_line("/a/b") == ignore.Rule(False, False, True, ("a", "b")) and ignore.parse_line(r"x\ ") == ignore.Rule(False, False, False, ("x ",))
    assert [len(ignore.parse_rules("*.a\nsyntax: glob\n*.b\nsyntax: regexp\n.c", "hg"))] == [1]
    for pattern, path, expected in MATCHES:
        assert column(spark, [path], lambda p, pattern=pattern: ignore.skipped(p, [ignore.parse_line(pattern)])) == [expected], (pattern, path)
    rules = ignore.parse_rules("dist/\n*.tmp\n!notes.tmp\n")
    assert column(spark, ["dist", "lib/a.tmp", "lib/notes.tmp", "lib/main.go", "dist/x"], lambda p: ignore.skipped(p, rules)) == [False, True, False, False, True]
    assert column(spark, ["dist"], lambda p: ignore.skipped(p, rules, True)) == [True]
    rules = ignore.parse_rules("deps/\n!deps/own.go\n")
    assert column(spark, ["deps/own.go", "deps/far/a.go"], lambda p: ignore.skipped(p, rules)) == [False, True]
    # Every slash before a pattern goes, one after it; blanks at the end but for an escaped one; Mercurial's lines are trimmed.
    assert ignore.parse_line("//a") == ignore.Rule(False, False, True, ("a",)) and ignore.parse_line("a//") == ignore.Rule(False, True, True, ("a", ""))
    assert ignore.parse_line("/") is None and ignore.parse_line("!") is None and ignore.parse_line("x\\  \t") == ignore.Rule(False, False, False, ("x ",))
    assert ignore.parse_rules("  syntax: glob\n  *.q  \n # no\n", "hg") == [ignore.Rule(False, False, False, ("*.q",))]


@pytest.fixture
def tree(tmp_path):
    files = {"a.py": "# c\nx = 1\n", "_hidden/b.py": "y = 2\n", ".dot.c": "int x;\n", "build/c.py": "z\n", "src/out": "x", "src/d.rs": "// a\n", "src/bin.c": "a\0b", "src/e.log": "x", "n/unknown.zzz": "q"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("*.log\n/n/\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    (tmp_path / "loop").symlink_to(tmp_path)
    return tmp_path


def test_listing(spark, tree):
    relative = lambda found: [p[len(str(tree)) + 1 :] for p in found]
    got = relative(list_files([str(tree), str(tree), str(tree / "missing")], ["build", "OUT", ".git"], Repositories([str(tree)])))
    assert got == sorted([".dot.c", ".gitignore", "_hidden/b.py", "a.py", "link.py", "src/bin.c", "src/d.rs"], key=lambda p: p.split("/"))
    assert relative(list_files([str(tree / "a.py"), str(tree)], [".git"])).count("a.py") == 2
    rows = {r.path: (r.is_binary, r.content) for r in read_contents(paths_frame(spark, [str(tree / "a.py"), str(tree / "src/bin.c"), str(tree / "gone")])).collect()}
    assert rows == {str(tree / "a.py"): (False, bytearray(b"# c\nx = 1\n")), str(tree / "src/bin.c"): (True, None)}


def test_counting_a_tree(spark, tree):
    options = Options(ignore_dirs=("build", ".git"))
    rows = {r.lang: (r.files, r.lines, r.comments, r.code) for r in count_paths(spark, [str(tree)], options).collect()}
    assert rows == {"Python": (3, 5, 2, 3), "C": (1, 1, 0, 1), "Rust": (1, 1, 1, 0), "Total": (5, 7, 3, 4)}
    text = json.loads(count(spark, [str(tree)], options.merged(format="json")))
    assert text["model"] == "deepseek" and text["languages"][0]["language"] == "Python" and text["total"]["files"] == 5
    assert count(spark, [str(tree / "missing")], options) == ""
    told = diagnostics(spark, [str(tree)], options)
    assert "binary files skipped: 1" in told and "files that could not be read: 0" in told and any(x.startswith("model: deepseek") for x in told)


def test_report_formats():
    rows, total = [("🔥Mojo", 1, 2000, 3, 0, 1, 2)], ("Total", 1, 2000, 3, 0, 1, 2)
    lines = report.render_table(rows, total).splitlines()
    assert lines[0].split() == list(report.HEADS) and lines[2].startswith("🔥Mojo") and "2,000" in lines[2] and len(lines) == 6
    assert report.render_markdown(rows, total).splitlines()[1] == "|" + " --- |" * 7
    assert report.render_markdown(rows, total).splitlines()[-1].startswith("| **Total** | 1 | 2,000")
    assert report.parse_format(" MD ") == "markdown"
    with pytest.raises(ValueError):
        report.parse_format("xml")


def test_vocabulary_files(tmp_path):
    assert vocab.read_varint(b"\x96\x01", 0) == (150, 2)
    for bad in (b"\x80", b"\x80" * 11):
        with pytest.raises(ValueError):
            vocab.read_varint(bad, 0)
    piece = lambda p, s, k: (lambda b: b"\x0a" + bytes([len(b)]) + b)(b"\x0a" + bytes([len(p)]) + p + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k]))
    assert vocab.parse_model(piece(b"ab", -1.5, 1) + piece(b"<0x0A>", 0.0, 6)) == [(b"ab", -1.5, 1), (b"<0x0A>", 0.0, 6)]
    assert vocab.parse_tiktoken(base64.b64encode(b"ab").decode() + " 1\n\n" + base64.b64encode(b"c").decode() + " 2\n") == {b"ab": 1, b"c": 2}
    with pytest.raises(ValueError):
        vocab.parse_tiktoken("bad line here\n")
    spec = {"model": {"vocab": {"a": 0, "Ġ": 1, "Ġa": 2}, "merges": ["Ġ a"]}}
    assert vocab.parse_tokenizer_json(json.dumps(spec)) == {b"a": 0, b" ": 1, b" a": 3}
    (tmp_path / "claude.tokenizer.json").write_text(json.dumps(spec))
    assert vocab.choose_tokenizer(resolve("claude"), tmp_path)[0] == "bpe" and vocab.choose_tokenizer(resolve("glm"), tmp_path) == ("approx", None)
    assert vocab.choose_tokenizer(resolve("glm"), tmp_path, any_file=True)[0] == "bpe"


def test_models_and_options(tmp_path, monkeypatch):
    assert [getattr(resolve(x), "name", None) for x in ("CLAUDE", "Qwen", "no such model")] == ["claude", "qwen", None]
    assert len(MODELS) == 13
    monkeypatch.setenv(config.CONFIG_VARIABLE, str(tmp_path / "c.toml"))
    assert config.load_config() == Options()
    config.write_default_config()
    assert config.load_config() == config.DEFAULTS
    assert config.parse_config('model = 3\nexts = ["a"]').exts == ("a",)
    (tmp_path / "c.toml").write_text("x = [")
    with pytest.warns(UserWarning):
        assert config.load_config() == Options()
    merged = config.DEFAULTS.merged(ignore=("x",), exts=("PY",), model="glm")
    assert merged.ignore_dirs[-1] == merged.ignore_langs[-1] == "x" and merged.exts == ("py",) and merged.model == "glm"
    args = cli.parser().parse_args(cli.spelled(["-m=glm", "--ext=a", "-e=b", "-j", "2", "--", "-x=y"]))
    assert (args.model, args.ext, args.jobs, args.paths) == ("glm", ["a", "b"], 2, ["-x=y"])
    for bad in ([], ["--nope"], ["-j", "0", "x"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 2
