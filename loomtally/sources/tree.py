"""Directory trees as a DataFrame source.

The driver lists names, never contents: pruned directories are not entered, rules on names run before any file is opened. Executors read
the contents, starting with the bytes that tell a binary file. Unlike Spark's own file source this sees names that begin with `_`
or `.`. Corpora in tables or object stores need no listing: `from_table`.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions.scalars import SNIFF_BYTES
from loomtally.operators.ignore import Rule, parse_rules, rule_regex

# What marks a repository of each kind, and its ignore file.
MARKERS = {"git": (".git",), "hg": (".hg",), "svn": (".svn",), "bzr": (".bzr",), "fossil": (".fslckout", ".fossil-settings")}
IGNORE_FILES = {"git": ".gitignore", "hg": ".hgignore", "svn": ".svnignore", "bzr": ".bzrignore", "fossil": ".ignore"}


class Repositories:
    """The repositories around the roots and the rules of the ignore files at their tops."""

    def __init__(self, roots: Iterable[str]) -> None:
        import re

        self.files: list[tuple[str, list[tuple[bool, re.Pattern, re.Pattern]]]] = []
        self.has_negations = False
        seen = set()
        for root in roots:
            at = Path(os.path.normpath(os.path.abspath(root)))
            for folder in (at, *at.parents):
                for kind, marks in MARKERS.items():
                    if (kind, folder) not in seen and any((folder / m).exists() for m in marks):
                        seen.add((kind, folder))
                        self._read(folder, kind)

    def _read(self, folder: Path, kind: str) -> None:
        import re

        try:
            rules: list[Rule] = parse_rules((folder / IGNORE_FILES[kind]).read_text(encoding="utf-8", errors="replace"), kind)
        except OSError:
            return
        self.has_negations |= any(r.negated for r in rules)
        python = lambda p: re.compile(p.replace(r"\z", r"\Z"))
        self.files.append((str(folder), [(r.negated, python(rule_regex(r)), python(rule_regex(r, True))) for r in rules]))

    def skips(self, path: str, is_dir: bool = False) -> bool:
        full = os.path.normpath(os.path.abspath(path))
        for folder, rules in self.files:
            if full.startswith(folder.rstrip("/") + "/"):
                relative = "/" + os.path.relpath(full, folder)
                for negated, on_file, on_dir in reversed(rules):
                    if (on_dir if is_dir else on_file).match(relative):
                        if not negated:
                            return True
                        break
        return False


def list_files(roots: Iterable[str], ignore_dirs: Iterable[str] = (), repositories: Repositories | None = None) -> list[str]:
    """Paths of all files below the roots, sorted by component. Missing roots are skipped, repeated ones taken once; links to files
    count, links to directories are not entered."""
    listed = {d.lower() for d in ignore_dirs}
    out: list[str] = []
    done, entered = set(), set()

    def push(path: str) -> None:
        if os.path.basename(path).lower() not in listed and not (repositories and repositories.skips(path)):
            out.append(path)

    for root in roots:
        real = os.path.realpath(root)
        if real in done or not os.path.exists(root):
            continue
        done.add(real)
        if os.path.isfile(root):
            push(str(root))
            continue
        queue = [str(root)]
        while queue:
            folder = queue.pop()
            if os.path.realpath(folder) in entered:
                continue
            entered.add(os.path.realpath(folder))
            try:
                entries = list(os.scandir(folder))
            except OSError:
                continue
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if e.name.lower() in listed or (repositories and not repositories.has_negations and repositories.skips(e.path, True)):
                        continue
                    queue.append(e.path)
                elif e.is_file():
                    push(e.path)
    return sorted(out, key=lambda p: p.split("/"))


def paths_frame(spark: SparkSession, paths: list[str], partitions: int | None = None) -> DataFrame:
    """path, dealt in chunks over the executors."""
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.repartition(partitions or max(1, min(len(paths) // 64 + 1, 4 * spark.sparkContext.defaultParallelism)))


def read_contents(files: DataFrame) -> DataFrame:
    """Adds is_binary and content. A file whose start holds a NUL is not read further; one that can't be read is dropped."""
    names = files.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = []
                for row in batch.iloc[at : at + 64].itertuples(index=False):
                    try:
                        with open(row[names.index("path")], "rb") as file:
                            head = file.read(SNIFF_BYTES)
                            binary = b"\x00" in head
                            rows.append((*row, binary, None if binary else head + file.read()))
                    except OSError:
                        continue
                yield pd.DataFrame(rows, columns=[*names, "is_binary", "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(read, f"{fields}, is_binary boolean, content binary")


def from_table(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, text and is_binary of a table that holds texts; nothing is listed and no Python runs."""
    from loomtally.functions.scalars import looks_binary_text

    return df.withColumns({"path": F.col(path), "text": F.col(text), "is_binary": looks_binary_text(F.col(text))})


def union_roots(*frames: DataFrame, distinct: str | None = None) -> DataFrame:
    """All rows of the roots; with distinct, a path that is in several of them counts once."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates([distinct]) if distinct else out
