"""The language registry as plain data: names, file names, and the comment and string syntax of each language."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StringSpec:
    """A string literal's delimiters; escape is a backslash or None."""

    start: str
    end: str
    multiline: bool = False
    escape: str | None = "\\"


@dataclass(frozen=True)
class Syntax:
    """What line classification needs to know of a language."""

    line: tuple[str, ...] = ()
    line_start: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    nestable: bool = False
    strings: tuple[StringSpec, ...] = ()
    raw: str | None = None

    @property
    def plain(self) -> bool:
        """Neither comments nor strings: only blank lines are told apart."""
        return not (self.line or self.line_start or self.block or self.strings or self.raw)


@dataclass(frozen=True)
class Language:
    id: int
    name: str
    aliases: tuple[str, ...]
    exts: tuple[str, ...]
    filenames: tuple[str, ...]
    syntax: Syntax


DOUBLE = StringSpec('"', '"')
SINGLE = StringSpec("'", "'")
TRIPLE_DOUBLE = StringSpec('"""', '"""', True)
TRIPLE_SINGLE = StringSpec("'''", "'''", True)
BACKQUOTED = StringSpec("`", "`", True, None)
LONG_BRACKETS = StringSpec("[[", "]]", True, None)

# Name, aliases, extensions, file names, line comments, line-start comments, blocks (start, end), nestable, strings, raw.
# The order is the priority: the first language that claims a key has it.
_ROWS = [
    ("C", ("c",), ("c", "h"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), None),
    ("C++", ("cpp", "cxx", "cc"), ("cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx", "h++", "ipp"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), "cpp"),
    ("Assembly", ("asm", "assembly", "s"), ("asm", "s", "S", "inc"), (), (";", "#"), ("@",), (), False, (DOUBLE, SINGLE), None),
    ("Java", ("java",), ("java",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), None),
    ("Kotlin", ("kotlin", "kt"), ("kt", "kts"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE,), None),
    ("Scala", ("scala", "sc"), ("scala", "sc"), (), ("//",), (), (("/*", "*/"),), True, (DOUBLE,), None),
    ("D", ("d",), ("d",), (), ("//",), (), (("/*", "*/"), ("/+", "+/")), True, (DOUBLE, SINGLE, BACKQUOTED), None),
    ("Vim Script", ("vim", "vimscript"), ("vim",), (), (), ("\"",), (), False, (DOUBLE, SINGLE), None),
    ("Bash", ("bash", "sh", "shell"), ("sh", "bash"), ("bashrc", "bash_profile", "profile"), ("#",), (), (), False, (DOUBLE, SINGLE), None),
    ("Zsh", ("zsh",), ("zsh",), ("zshrc", "zprofile", "zlogin", "zshenv"), ("#",), (), (), False, (DOUBLE, SINGLE), None),
    ("Fish", ("fish",), ("fish",), (), ("#",), (), (), False, (DOUBLE, SINGLE), None),
    ("Perl", ("perl", "pl"), ("pl", "pm", "t"), (), ("#",), (), (), False, (DOUBLE, SINGLE), None),
    ("Python", ("python", "py"), ("py", "pyw", "pyi"), (), ("#",), (), (), False, (DOUBLE, SINGLE, TRIPLE_DOUBLE, TRIPLE_SINGLE), None),
    ("🔥Mojo", ("mojo", "🔥"), ("mojo", "🔥"), (), ("#",), (), (), False, (DOUBLE, SINGLE, TRIPLE_DOUBLE, TRIPLE_SINGLE), None),
    ("Tcl", ("tcl", "tk"), ("tcl", "tk"), (), ("#",), (), (), False, (DOUBLE,), None),
    ("Lua", ("lua",), ("lua",), (), ("--",), (), (("--[[", "]]"),), False, (DOUBLE, SINGLE, LONG_BRACKETS), None),
    ("PHP", ("php",), ("php", "php3", "php4", "php5", "phtml"), (), ("//", "#"), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), None),
    ("Ruby", ("ruby", "rb"), ("rb", "rake", "gemspec"), ("Gemfile", "Rakefile", "Guardfile"), ("#",), (), (("=begin", "=end"),), False, (DOUBLE, SINGLE), None),
    ("SQL", ("sql",), ("sql",), (), ("--",), (), (("/*", "*/"),), False, (SINGLE, DOUBLE), None),
    ("JSON", ("json",), ("json", "jsonc"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE,), None),
    ("XML", ("xml",), ("xml", "xsd", "xsl", "xslt", "svg", "qrc", "plist", "pom"), (), (), (), (("<!--", "-->"),), False, (DOUBLE, SINGLE), None),
    ("XHTML", ("xhtml",), ("xhtml",), (), (), (), (("<!--", "-->"),), False, (DOUBLE, SINGLE), None),
    ("HTML", ("html", "htm"), ("html", "htm"), (), (), (), (("<!--", "-->"),), False, (DOUBLE, SINGLE), None),
    ("CSS", ("css",), ("css", "scss", "sass", "less"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), None),
    ("JavaScript", ("js", "javascript"), ("js", "mjs", "cjs"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE, BACKQUOTED), None),
    ("JSX", ("jsx", "react"), ("jsx",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE, BACKQUOTED), None),
    ("TypeScript", ("ts", "typescript"), ("ts", "mts", "cts"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE, BACKQUOTED), None),
    ("TSX", ("tsx",), ("tsx",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE, BACKQUOTED), None),
    ("TOML", ("toml",), ("toml",), (), ("#",), (), (), False, (DOUBLE, SINGLE), None),
    ("YAML", ("yaml", "yml"), ("yaml", "yml"), (), ("#",), (), (), False, (DOUBLE, SINGLE), None),
    ("INI", ("ini", "cfg", "conf"), ("ini", "cfg", "conf", "properties"), (), (";", "#"), (), (), False, (DOUBLE, SINGLE), None),
    ("Dockerfile", ("dockerfile", "containerfile"), ("dockerfile", "containerfile"), ("Dockerfile", "Containerfile"), ("#",), (), (), False, (DOUBLE, SINGLE), None),
    ("Makefile", ("make", "makefile", "mk"), ("mk", "mak"), ("Makefile", "makefile", "GNUmakefile"), ("#",), (), (), False, (DOUBLE, SINGLE), None),
    ("Ninja", ("ninja", "ninja.build"), ("ninja",), ("build.ninja", "rules.ninja", "toolchain.ninja"), ("#",), (), (), False, (DOUBLE, SINGLE), None),
    ("CMake", ("cmake", "cmakelists"), ("cmake",), ("CMakeLists.txt",), ("#",), (), (("#[[", "]]"),), False, (DOUBLE, SINGLE), None),
    ("Markdown", ("markdown", "md"), ("md", "markdown", "mdown"), (), (), (), (), False, (), None),
    ("LaTeX", ("latex", "tex"), ("tex", "sty", "cls", "bib"), (), ("%",), (), (), False, (), None),
    ("Texinfo", ("texinfo", "texi"), ("texi", "texinfo", "txi"), (), (), ("@c", "@comment"), (), False, (), None),
    ("GCC MD", ("gccmd", "gcc-md", "gcc_md"), (), (), (";;",), (), (), False, (DOUBLE,), None),
    ("Rust", ("rust", "rs"), ("rs",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE,), "rust"),
    ("Go", ("go", "golang"), ("go",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, BACKQUOTED), None),
    ("Swift", ("swift",), ("swift",), (), ("//",), (), (("/*", "*/"),), True, (DOUBLE,), None),
    ("CUDA", ("cuda", "cu"), ("cu", "cuh"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), None),
    ("HIP", ("hip", "rocm", "amd-gpu"), ("hip",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), None),
    ("Metal", ("metal", "msl"), ("metal",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), None),
    ("GLSL", ("glsl", "opengl-shader"), ("glsl", "vert", "frag", "comp", "tesc", "tese", "geom"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), None),
    ("HLSL", ("hlsl", "directx-shader", "fx"), ("hlsl", "fx", "fxh"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE, SINGLE), None),
    ("WGSL", ("wgsl", "webgpu-shader"), ("wgsl",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE,), None),
    ("WAT", ("wat", "wast", "webassembly-text"), ("wat", "wast"), (), (";;",), (), (("(;", ";)"),), True, (DOUBLE,), None),
    ("Verilog", ("verilog", "v"), ("v",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE,), None),
    ("SystemVerilog", ("systemverilog", "sv"), ("sv", "svh"), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE,), None),
    ("VHDL", ("vhdl", "vhd"), ("vhd", "vhdl"), (), ("--",), (), (), False, (DOUBLE, SINGLE), None),
    ("TableGen", ("tablegen", "td", "llvm"), ("td",), (), ("//",), (), (("/*", "*/"),), False, (DOUBLE,), None),
]


def _language(i: int, row: tuple) -> Language:
    name, aliases, exts, filenames, line, line_start, block, nestable, strings, raw = row
    return Language(i, name, aliases, exts, filenames, Syntax(line, line_start, block, nestable, strings, raw))


LANGUAGES: tuple[Language, ...] = tuple(_language(i, row) for i, row in enumerate(_ROWS))
BY_NAME = {lang.name: lang for lang in LANGUAGES}
#: For files of no known language: no comments, two kinds of strings.
GENERIC = Syntax(strings=(DOUBLE, SINGLE))
GENERIC_ID = -1


def by_alias(name: str) -> Language | None:
    """The language of a name or alias, whatever its case."""
    low = name.lower()
    return next((lang for lang in LANGUAGES if low == lang.name.lower() or low in (a.lower() for a in lang.aliases)), None)


def first_claims(keys: str) -> list[tuple[str, int]]:
    """(lower-cased key, language id) for `exts` or `filenames`; the first language in order has a key."""
    out: dict[str, int] = {}
    for lang in LANGUAGES:
        for key in getattr(lang, keys):
            out.setdefault(key.lower(), lang.id)
    return list(out.items())
