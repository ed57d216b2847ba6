"""Line classification as column expressions.

One alternation of patterns partitions a text into lexemes: raw strings, strings, comments, ordinary runs and single characters, in the
order in which a scanner would try them. Every string becomes a mark, every comment another, once per line that it covers; what
is left between newlines then tells code, comment and blank lines apart. No Python runs, but for texts whose comments may be
nested more than DEPTH deep, to which the pattern is expanded.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtally.functions.languages import GENERIC, GENERIC_ID, LANGUAGES, Syntax

DEPTH = 12
COMMENT, STRING = "\x01", "\x02"
BLANK = r" \t\n\f\r"
MEASURES = ("lines", "blanks", "comments", "code")


def quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def in_class(characters: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "\n" else c.replace("\n", r"\n") for c in characters)


def _string_pattern(s) -> str:
    a, b = quoted(s.start), quoted(s.end)
    first = in_class(s.end[0])
    if not s.multiline:
        return rf"{a}[^{first}\\\n]*+(?:\\[^\n][^{first}\\\n]*+)*+[{first}\\]?"
    if s.escape is None:
        return rf"{a}[\s\S]*?(?:{b}|\z)"
    return rf"{a}(?:[^\\{first}]++|\\[\s\S]?|(?!{b}){first})*+(?:{b}|\z)"


def _block_patterns(syntax: Syntax, depth: int) -> list[str]:
    if not syntax.nestable:
        return [rf"{quoted(a)}[\s\S]*?(?:{quoted(b)}|\z)" for a, b in syntax.block]
    starts = "(?:" + "|".join(quoted(a) for a, _ in syntax.block) + ")"
    ends = "(?:" + "|".join(quoted(b) for _, b in syntax.block) + ")"
    first_a, first_b = (in_class("".join(dict.fromkeys(pair[k][0] for pair in syntax.block))) for k in (0, 1))
    pattern = rf"{starts}(?:[^{first_b}]++|(?!{ends})[\s\S])*+(?:{ends}|\z)"
    for _ in range(depth):
        pattern = rf"{starts}(?:[^{first_a}{first_b}]++|(?!{starts}|{ends})[\s\S]|{pattern})*+(?:{ends}|\z)"
    return [pattern]


def lexeme_pattern(syntax: Syntax, depth: int = DEPTH) -> str:
    """A pattern whose matches, one after another, cover the whole text."""
    strings = sorted(syntax.strings, key=lambda s: -len(s.start))
    parts = {
        "cpp": [r'R"(?<d>[^(\n]*)\([\s\S]*?(?:\)\k<d>"|\z)', r'R"'],
        "rust": [r'r(?<h>#+)"[\s\S]*?(?:"\k<h>|\z)', r'r"'],
        None: [],
    }[syntax.raw]
    parts = [*parts, *map(_string_pattern, strings), *_block_patterns(syntax, depth), *(rf"{quoted(m)}[^\n]*" for m in syntax.line)]
    shadowed = {s.start for s in strings}
    starts = [m for m in syntax.line_start if not any(m.startswith(s) for s in shadowed)]
    if starts:
        parts.append(rf"(?dm:^)[ \t\f\r]*(?:{'|'.join(map(quoted, starts))})[^\n]*")
    marks = [*(s.start for s in strings), *(a for a, _ in syntax.block), *syntax.line, *({"cpp": ["R"], "rust": ["r"], None: []}[syntax.raw])]
    firsts = in_class("".join(dict.fromkeys(m[0] for m in marks)))
    return "|".join([*parts, rf"[^{firsts}\n]++", r"[\s\S]"])


def _kind_pattern(syntax: Syntax) -> tuple[str, str]:
    """What a string lexeme and a comment lexeme begin with."""
    strings = [quoted(s.start) for s in sorted(syntax.strings, key=lambda s: -len(s.start))] + {"cpp": ['R"'], "rust": ["r#*\""], None: []}[syntax.raw]
    shadowed = {s.start for s in syntax.strings}
    comments = [quoted(a) for a, _ in syntax.block] + [quoted(m) for m in syntax.line]
    comments += [rf"[ \t\f\r]*{quoted(m)}" for m in syntax.line_start if not any(m.startswith(s) for s in shadowed)]
    never = r"(?!)"
    return "^(?:" + ("|".join(strings) or never) + ")", "^(?:" + ("|".join(comments) or never) + ")"


def _marked(lexeme: Column, mark: str) -> Column:
    newlines = F.regexp_replace(lexeme, r"[^\n]+", "")
    return F.concat(F.lit(mark), F.replace(newlines, F.lit("\n"), F.lit("\n" + mark)))


def marked_text(text: Column, syntax: Syntax) -> Column:
    """The text with strings and comments replaced by their marks."""
    clean = F.translate(text, COMMENT + STRING, "\x03\x03")
    if syntax.plain:
        return clean
    string, comment = _kind_pattern(syntax)
    lexemes = F.regexp_extract_all(clean, F.lit(lexeme_pattern(syntax)), F.lit(0))
    return F.array_join(F.transform(lexemes, lambda x: F.when(x.rlike(string), _marked(x, STRING)).when(x.rlike(comment), _marked(x, COMMENT)).otherwise(x)), "")


def without_last_newline(text: Column) -> Column:
    """A final newline begins no line; it is taken away before strings and comments are marked, as it may stand in one."""
    return F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def line_array(text: Column, marked: Column) -> Column:
    """Lines of a text, split at newlines; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(marked, "\n", -1))


def classify(lines: Column) -> Column:
    """A struct of MEASURES as longs."""
    code = F.size(F.filter(lines, lambda x: x.rlike(rf"[^{COMMENT}{BLANK}]"))).cast("long")
    blank = F.size(F.filter(lines, lambda x: ~x.rlike(rf"[^{BLANK}]"))).cast("long")
    total = F.size(lines).cast("long")
    return F.struct(total.alias("lines"), blank.alias("blanks"), (total - blank - code).alias("comments"), code.alias("code"))


def nesting_bound(text: Column, syntax: Syntax) -> Column:
    """No comment of the text is nested more deeply than this: the deepest level that starts and ends reach if strings hide none of them. An end
    that overlaps a start lowers nothing, since a scanner outside of comments sees the start alone."""
    starts, ends = [a for a, _ in syntax.block], [b for _, b in syntax.block]
    joint = {e + a[k:] for e in ends for a in starts for k in range(1, len(a)) if e.endswith(a[:k])}
    marks = F.regexp_extract_all(text, F.lit("|".join(quoted(m) for m in [*sorted(joint, key=len, reverse=True), *starts, *ends])), F.lit(0))

    def step(acc: Column, mark: Column) -> Column:
        now = F.when(mark.isin(*starts), acc["now"] + 1).when(mark.isin(*joint), F.greatest(acc["now"], F.lit(1))) if joint else F.when(mark.isin(*starts), acc["now"] + 1)
        now = now.otherwise(F.greatest(acc["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda acc: acc["top"])


def mark_by_jumps(text: str, syntax: Syntax) -> str:
    """marked_text of one text whatever its nesting: outside of comments one lexeme after another, inside from one start or end to the next."""
    python = lambda p: p.replace(r"\z", r"\Z").replace("(?<d>", "(?P<d>").replace("(?<h>", "(?P<h>").replace(r"\k<d>", "(?P=d)").replace(r"\k<h>", "(?P=h)").replace("(?dm:", "(?m:")
    text = text.translate({1: 3, 2: 3})
    flat = Syntax(**{**{f: getattr(syntax, f) for f in syntax.__dataclass_fields__}, "nestable": False})
    lexeme, (string, comment) = re.compile(python(lexeme_pattern(flat))), (re.compile(python(p)) for p in _kind_pattern(syntax))
    opens = re.compile("|".join(quoted(a) for a, _ in syntax.block))
    either = re.compile("|".join(f"({quoted(a)})|{quoted(b)}" for a, b in syntax.block))
    out, at = [], 0
    while at < len(text):
        found = lexeme.match(text, at)
        end, kind = found.end(), None
        if string.match(found[0]):
            kind = STRING
        elif comment.match(found[0]):
            kind = COMMENT
            if (first := opens.match(text, at)) and found[0].startswith(first[0]):
                depth, end = 1, first.end()
                while depth and (jump := either.search(text, end)):
                    depth, end = depth + (1 if jump.lastindex else -1), jump.end()
                end = len(text) if depth else end
        part = text[at:end]
        out.append(part if kind is None else kind + re.sub(r"[^\n]+", "", part).replace("\n", "\n" + kind))
        at = end
    return "".join(out)


def line_stats(text: Column, syntax: Syntax) -> Column:
    """A struct of lines, blanks, comments and code of each text under one syntax; null for a null text."""
    body = without_last_newline(text)
    marked = marked_text(body, syntax)
    if syntax.nestable:
        deep = nesting_bound(body, syntax) > DEPTH

        @F.pandas_udf("string")
        def mark(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else mark_by_jumps(t, syntax))

        # Texts that the pattern covers are null to the function.
        marked = F.when(deep, mark(F.when(deep, body))).otherwise(marked)
    return F.when(text.isNotNull(), classify(line_array(text, marked)))


def line_stats_mixed(text: Column, lang_id: Column, ids: list[int] | None = None) -> Column:
    """line_stats by language id; ids: those that occur, which keeps the plan small. Languages of one syntax share a branch."""
    groups: dict[Syntax, list[int]] = {}
    for lang in LANGUAGES:
        if ids is None or lang.id in ids:
            groups.setdefault(lang.syntax, []).append(lang.id)
    if ids is None or GENERIC_ID in ids:
        groups.setdefault(GENERIC, []).append(GENERIC_ID)
    out = None
    for syntax, members in groups.items():
        hit = lang_id.isin(members)
        stats = line_stats(text, syntax)
        out = F.when(hit, stats) if out is None else out.when(hit, stats)
    return out
