"""Line classification: golden cases, and the patterns against a plain yardstick on random texts of each syntax's own marks."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loomtally.functions.languages import BY_NAME, GENERIC, LANGUAGES
from loomtally.functions import lines
from loomtally.functions.lines import MEASURES, line_stats

GOLDEN = [
    ("C", "int a; /* one */\n/* two */\n\n", (3, 1, 1, 1)),
    ("C", "int a; /* one */\n/* two */\n", (2, 0, 1, 1)),
    ("C", "\t/* p\n\n  q */\n/* r */ z();\n", (4, 0, 3, 1)),
    ("C", "puts(\"/* not */ // no\");\n'/*';\n", (2, 0, 0, 2)),
    ("C", "/* never closed\nx;\n", (2, 0, 2, 0)),
    ("C", "x = \"open\ny = 1; // c\n", (2, 0, 0, 2)),
    ("Python", "def f():\n    \"\"\"text\n\n    # not one\n    \"\"\"\n    # one\n", (6, 0, 1, 5)),
    ("Rust", "br#\"\n/* no\n\n\"#;\n/* yes */\n", (5, 0, 1, 4)),
    ("C++", "R\"tag(\n)\" // inside\n)tag\";\n// outside\n", (4, 0, 1, 3)),
    ("Swift", "/* 1 /* 2 /* 3 */ */\nstill */ let y = 2\nvar z\n", (3, 0, 1, 2)),
    ("C", "", (0, 0, 0, 0)),
    ("C", "\n\n", (2, 2, 0, 0)),
    ("Vim Script", '" is this a comment\n', (1, 0, 0, 1)),
    ("Texinfo", "@cite it\nwords\n", (2, 0, 1, 1)),
    ("Rust", 'r"\n// a comment\n";\n', (3, 0, 1, 2)),
    ("Markdown", " \x0b\n\n \t\ntext", (4, 2, 0, 2)),
]


def yardstick(text, syntax):
    """The rules told anew: find the earliest mark, find its end, note which lines it lies on. Slow and plain."""
    whole, text = text, text.removesuffix("\n")
    if not text:
        return (1, 1, 0, 0) if whole else (0, 0, 0, 0)
    n, at, spans = len(text), 0, []

    def closed(mark, start):
        found = text.find(mark, start)
        return n if found < 0 else found + len(mark)

    def string_end(s, i):
        if s.multiline and s.escape is None:
            return closed(s.end, i)
        while i < n:
            if text[i] == "\n" and not s.multiline:
                return i
            if text[i] == "\\":
                if not s.multiline and text[i + 1 : i + 2] in ("", "\n"):
                    return i + 1
                i += 2
            elif text.startswith(s.end, i):
                return i + len(s.end)
            else:
                i += 1
        return min(i, n)

    def block_end(i, end):
        if not syntax.nestable:
            return closed(end, i)
        depth = 1
        while depth and i < n:
            hit = next(((1, m) for m, _ in syntax.block if text.startswith(m, i)), None) or next(((-1, m) for _, m in syntax.block if text.startswith(m, i)), (0, "x"))
            depth, i = depth + hit[0], i + len(hit[1])
        return i if not depth else n

    def options():
        if syntax.raw == "cpp" and (i := text.find('R"', at)) >= 0:
            m = re.compile(r'R"([^(\n]*)\(').match(text, i)
            yield i, 0, "string", lambda m=m, i=i: closed(")" + m[1] + '"', m.end()) if m else i + 2
        if syntax.raw == "rust" and (m := re.compile(r'r(#*)"').search(text, at)):
            yield m.start(), 0, "string", lambda m=m: closed('"' + m[1], m.end()) if m[1] else m.end()
        for k, s in enumerate(sorted(syntax.strings, key=lambda s: -len(s.start))):
            if (i := text.find(s.start, at)) >= 0:
                yield i, 1 + k, "string", lambda s=s, i=i: string_end(s, i + len(s.start))
        for k, (a, b) in enumerate(syntax.block):
            if (i := text.find(a, at)) >= 0:
                yield i, 100 + k, "comment", lambda a=a, b=b, i=i: block_end(i + len(a), b)
        eol = lambda i: n if (j := text.find("\n", i)) < 0 else j
        for k, m in enumerate(syntax.line):
            if (i := text.find(m, at)) >= 0:
                yield i, 200 + k, "comment", lambda i=i: eol(i)
        for m in syntax.line_start:
            if not any(m.startswith(s.start) for s in syntax.strings):
                for hit in re.compile(r"(?m:^)[ \t\f\r]*" + re.escape(m)).finditer(text, at):
                    if hit.start() == 0 or text[hit.start() - 1] == "\n":
                        yield hit.start(), 300, "comment", lambda hit=hit: eol(hit.end())
                        break

    while at < n and (found := sorted(options(), key=lambda o: o[:2])):
        start, _, kind, end = found[0]
        spans.append((start, max(end(), start + 1), kind))
        at = spans[-1][1]
    rows = text.count("\n") + 1
    state = [set() for _ in range(rows)]
    plain = list(text)
    for a, b, kind in spans:
        line = text.count("\n", 0, a)
        for k in range(line, line + text.count("\n", a, b) + 1):
            state[k].add(kind)
        plain[a:b] = ["\n" if c == "\n" else " " for c in text[a:b]]
    code = [bool(re.search(r"[^ \t\f\r]", x)) or "string" in s for x, s in zip("".join(plain).split("\n"), state, strict=True)]
    comment = ["comment" in s and not c for s, c in zip(state, code, strict=True)]
    return rows, rows - sum(code) - sum(comment), sum(comment), sum(code)


def classified(spark, texts, syntax):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", line_stats(F.col("t"), syntax).alias("s")).orderBy("i").collect()
    return [tuple(r.s[m] for m in MEASURES) if r.s is not None else None for r in rows]


def test_golden_cases(spark):
    for name in dict.fromkeys(g[0] for g in GOLDEN):
        own = [g for g in GOLDEN if g[0] == name]
        assert classified(spark, [g[1] for g in own], BY_NAME[name].syntax) == [g[2] for g in own], name
        assert [yardstick(g[1], BY_NAME[name].syntax) for g in own] == [g[2] for g in own], name


SYNTAXES = {lang.syntax: lang.name for lang in reversed(LANGUAGES)}


@pytest.mark.parametrize("syntax", [*SYNTAXES, GENERIC], ids=[*SYNTAXES.values(), "generic"])
def test_patterns_equal_the_yardstick(spark, syntax):
    rnd = random.Random(str(syntax))
    marks = [*syntax.line, *syntax.line_start, *(x for pair in syntax.block for x in pair), *(s.start for s in syntax.strings)]
    marks += {"cpp": ['R"', "(", ')"', ')a"', 'R"a('], "rust": ['r"', 'r#"', '"#', "#", 'r##"'], None: []}[syntax.raw]
    pool = [*marks, *marks, "\n", "\n", " ", "\t", "a", "\\", "\r", "é", "r"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 16))) for _ in range(400)]
    got = classified(spark, texts, syntax)
    for text, stats in zip(texts, got, strict=True):
        assert stats == yardstick(text, syntax), repr(text)


def test_deep_nesting_and_nulls(spark):
    syntax = BY_NAME["Swift"].syntax
    deep = "/*" * 40 + "\n" + "*/" * 39 + "\nstill\n*/ x\n"
    assert classified(spark, [deep, None, "let x\n"], syntax) == [(4, 0, 3, 1), None, (1, 0, 0, 1)]


def test_jumps_equal_the_patterns(spark, monkeypatch):
    monkeypatch.setattr(lines, "DEPTH", 1)
    rnd = random.Random(5)
    for name in ("Swift", "Scala", "D", "Rust"):
        syntax = BY_NAME[name].syntax
        pool = [x for pair in syntax.block for x in pair] * 3 + ["*/*", "/*/", "\n", " ", "a", '"', "//", "\\"]
        texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
        assert classified(spark, texts, syntax) == [yardstick(t, syntax) for t in texts]
        bounds = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lines.nesting_bound(F.col("t"), syntax)).collect()]
        assert max(bounds) > 1 and min(bounds) == 0


def test_flat_comments_are_not_deep(spark):
    df = spark.createDataFrame([("/* a */ x\n" * 50,)], "t string")
    assert df.select(lines.nesting_bound(F.col("t"), BY_NAME["Swift"].syntax)).first()[0] == 1


def test_long_lexemes_do_not_overflow_the_stack(spark):
    text = '"' + "\\x" * 100_000 + '"\n/*' + "a\n" * 50_000 + "*/\n"
    assert classified(spark, [text], BY_NAME["C"].syntax) == [(50_002, 0, 50_001, 1)]
