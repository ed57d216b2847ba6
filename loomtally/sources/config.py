"""Options and their sources: keyword arguments, a small TOML file, built-in defaults."""

from __future__ import annotations

import os
import tomllib
import warnings
from dataclasses import dataclass, replace
from pathlib import Path

from loomtally.functions.models import DEFAULT_MODEL

# What the configuration template ignores.
IGNORE_DIRS = [
    "node_modules", "target", ".git", ".hg", ".svn", "dist", "build", "out", "coverage", "__pycache__", ".venv", "venv", ".idea", ".vscode",
    ".next", ".nuxt", "vendor", "Pods", ".gradle", ".terraform", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox",
    ".dart_tool",
]
IGNORE_LANGS = ["svg", "lock", "map"]
CONFIG_VARIABLE = "LOOMTALLY_CONFIG"


@dataclass(frozen=True)
class Options:
    model: str = DEFAULT_MODEL
    format: str = "table"
    ignore_dirs: tuple[str, ...] = ()
    ignore_langs: tuple[str, ...] = ()
    exts: tuple[str, ...] = ()
    tokenizer_dir: str | None = None
    use_vcs: bool = True
    partitions: int | None = None
    verbose: bool = False

    def merged(self, *, ignore: tuple[str, ...] = (), exts: tuple[str, ...] = (), **given) -> Options:
        """Given values win over these; lists are united. `ignore` names both directories and languages."""
        union = lambda a, b: tuple(dict.fromkeys([*a, *b]))
        kept = {k: v for k, v in given.items() if v is not None}
        return replace(
            self, ignore_dirs=union(self.ignore_dirs, ignore), ignore_langs=union(self.ignore_langs, ignore), exts=union(self.exts, [e.lower() for e in exts]), **kept
        )


DEFAULTS = Options(ignore_dirs=tuple(IGNORE_DIRS), ignore_langs=tuple(IGNORE_LANGS))


def config_path() -> Path:
    """The file named by the environment variable, else the one in the user's configuration folder."""
    if named := os.environ.get(CONFIG_VARIABLE):
        return Path(named)
    base = os.environ.get("XDG_CONFIG_HOME") or os.environ.get("APPDATA") or Path.home() / ".config"
    return Path(base) / "loomtally" / "config.toml"


def parse_config(text: str) -> Options:
    """Options of a TOML text; keys of a wrong type are ignored, tables are an error."""
    data = tomllib.loads(text)
    if any(isinstance(v, dict) for v in data.values()):
        raise ValueError("tables are not expected here")
    strings = {k: v for k, v in data.items() if k in ("model", "format", "tokenizer_dir") and isinstance(v, str)}
    lists = {k: tuple(v) for k, v in data.items() if k in ("ignore_dirs", "ignore_langs", "exts") and isinstance(v, list) and all(isinstance(x, str) for x in v)}
    return Options(**strings, **lists)


def load_config(path: str | Path | None = None) -> Options:
    """The file's options; empty ones, with a warning, if it can't be parsed; empty ones if there is none."""
    path = Path(path or config_path())
    try:
        return parse_config(path.read_text(encoding="utf-8"))
    except OSError:
        return Options()
    except ValueError as e:
        warnings.warn(f"{path}: {e}", stacklevel=2)
        return Options()


def default_config() -> str:
    listed = lambda name, values: f"{name} = [\n" + "".join(f'  "{v}",\n' for v in values) + "]\n"
    return f'model = "{DEFAULTS.model}"\nformat = "{DEFAULTS.format}"\n' + listed("ignore_dirs", IGNORE_DIRS) + listed("ignore_langs", IGNORE_LANGS) + "exts = []\n"


def write_default_config(path: str | Path | None = None) -> Path:
    """Writes the template unless the file is there."""
    path = Path(path or config_path())
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(default_config(), encoding="utf-8")
    return path
