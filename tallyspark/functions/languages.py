"""The language dimension: comment and string tokens, file names, complexity keywords."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Block:
    open: str
    close: str
    nested: bool = False
    line_start: bool = False


@dataclass(frozen=True)
class Quote:
    open: str
    multiline: bool = False
    doc: bool = False
    escape: str | None = "\\"
    close_with: str | None = None
    doubled: bool = False

    @property
    def close(self) -> str:
        return self.close_with or self.open


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    line: tuple[str, ...] = ()
    blocks: tuple[Block, ...] = ()
    quotes: tuple[Quote, ...] = ()
    keywords: tuple[str, ...] = ()
    health: bool = True
    line_exceptions: tuple[str, ...] = ()
    token_exceptions: tuple[str, ...] = ()
    doc_prefixes: tuple[str, ...] = ()
    ignore_case: bool = False
    digit_separators: bool = False
    quoted_quote: bool = False
    operator_aware: bool = False
    regex_literals: bool = False
    exact_filenames: bool = False

    @property
    def supports_health(self) -> bool:
        return self.health and bool(self.line or self.blocks)

    @property
    def supports_complexity(self) -> bool:
        return bool(self.keywords)


# Fixed values from here on: tokens, names and keyword sets that results depend on.
C, CN, HTML = Block("/*", "*/"), Block("/*", "*/", nested=True), Block("<!--", "-->")
ML, HS, LISP, RAZOR = Block("(*", "*)", nested=True), Block("{-", "-}", nested=True), Block("#|", "|#", nested=True), Block("@*", "*@")
LUA = tuple(Block(f"--[{'=' * n}[", f"]{'=' * n}]") for n in range(5))
POD = tuple(
    Block("=" + w, "=cut", line_start=True)
    for w in ("pod", "head1", "head2", "head3", "head4", "head5", "head6", "over", "item", "back", "begin", "end", "for", "encoding")
)
DQ, SQ = Quote('"'), Quote("'")
TICK, RAW_TICK = Quote("`", multiline=True), Quote("`", multiline=True, escape=None)
PY3D, PY3S = Quote('"""', multiline=True, doc=True), Quote("'''", multiline=True, doc=True)
RAW3D, RAW3S = Quote('"""', multiline=True, escape=None), Quote("'''", multiline=True, escape=None)
ESC3D, ESC3S = Quote('"""', multiline=True), Quote("'''", multiline=True)
CS_VERBATIM = Quote('@"', multiline=True, escape=None, close_with='"', doubled=True)
CS_INTERPOLATED = Quote('@$"', multiline=True, escape=None, close_with='"', doubled=True)
DBL_DQ, DBL_SQ = Quote('"', escape=None, doubled=True), Quote("'", escape=None, doubled=True)
PS_DQ, PS_SQ = Quote('"', multiline=True, escape="`"), Quote("'", multiline=True, escape=None, doubled=True)
CPP_RAW = Quote('R"(', multiline=True, escape=None, close_with=')"')
RUST_RAW, RUST_RAW1 = Quote('r"', multiline=True, escape=None, close_with='"'), Quote('r#"', multiline=True, escape=None, close_with='"#')
K_C = ("if", "for", "while", "case", "&&", "||", "?:")
K_CSTYLE = ("if", "for", "while", "case", "catch", "&&", "||", "?:")
K_CSHARP, K_PHP = (*K_CSTYLE, "foreach"), (*K_CSTYLE, "foreach", "elseif")
K_PYTHON = ("if", "elif", "for", "while", "except", "and", "or")
K_RUBY = ("if", "elsif", "for", "while", "case", "rescue", "&&", "||")
K_RUST = ("if", "for", "while", "match", "&&", "||")
K_KOTLIN = ("if", "for", "while", "when", "catch", "&&", "||")
K_SWIFT = ("if", "for", "while", "case", "catch", "guard", "&&", "||")
K_GO = ("if", "for", "case", "&&", "||")
CS_QUOTES = (CS_VERBATIM, CS_INTERPOLATED, RAW3D, DQ, SQ)
LISP_CHARS = ('#\\"', "#\\;")


def _l(name: str, files: str = "", line: str = "", blocks=(), quotes=(), keywords=(), **more) -> Language:
    """files: blank-separated extensions (.x) and names; line: blank-separated tokens."""
    words = files.split()
    suffixes = tuple(w for w in words if w.count(".") > 1 and w.startswith("."))
    extensions = tuple(w for w in words if w.startswith(".") and w not in suffixes)
    names = tuple(w for w in words if not w.startswith("."))
    return Language(name, extensions, names, suffixes, tuple(line.split()), tuple(blocks), tuple(quotes), tuple(keywords), **more)


LANGUAGES: tuple[Language, ...] = (
    _l("C#", ".cs .csx", "//", [C], CS_QUOTES, K_CSHARP),
    _l("C", ".c .h", "//", [C], [DQ, SQ], K_C, digit_separators=True),
    _l("C++", ".cpp .hpp .cc .cxx .hxx .ipp", "//", [C], [CPP_RAW, DQ, SQ], K_CSTYLE, digit_separators=True),
    _l("Java", ".java", "//", [C], [ESC3D, DQ, SQ], K_CSTYLE),
    _l("Kotlin", ".kt .kts", "//", [CN], [RAW3D, DQ, SQ], K_KOTLIN),
    _l("Swift", ".swift", "//", [CN], [ESC3D, DQ], K_SWIFT),
    _l("JavaScript", ".js .jsx .mjs .cjs", "//", [C], [TICK, DQ, SQ], K_CSTYLE, regex_literals=True),
    _l("TypeScript", ".ts .tsx .mts .cts", "//", [C], [TICK, DQ, SQ], K_CSTYLE, regex_literals=True),
    _l("Python", ".py .pyw", "#", (), [PY3D, PY3S, DQ, SQ], K_PYTHON, doc_prefixes=("r", "R", "u", "U")),
    _l("Go", ".go", "//", [C], [RAW_TICK, DQ, SQ], K_GO),
    _l("Rust", ".rs", "//", [CN], [RUST_RAW1, RUST_RAW, DQ], K_RUST, quoted_quote=True),
    _l("PHP", ".php", "// #", [C], [DQ, SQ], K_PHP, line_exceptions=("#[",)),
    _l("Ruby", ".rb Rakefile Gemfile Guardfile Podfile", "#", [Block("=begin", "=end", line_start=True)], [DQ, SQ], K_RUBY),
    _l("F#", ".fs .fsi .fsx", "//", [ML], [DQ], quoted_quote=True, token_exceptions=("(*)",)),
    _l("Visual Basic", ".vb", "' REM", (), [DQ], ignore_case=True),
    _l("SQL", ".sql", "--", [C], [SQ, DQ]),
    _l("PowerShell", ".ps1 .psm1 .psd1", "#", [Block("<#", "#>")], [PS_DQ, PS_SQ]),
    _l("Shell", ".sh .bash .zsh", "#", (), [DQ, SQ]),
    _l("YAML", ".yml .yaml", "#", (), [DQ, SQ], health=False),
    _l("JSON", ".json .jsonc", "//", [C], [DQ], health=False),
    _l("HTML", ".html .htm .cshtml .vbhtml", "", [HTML, RAZOR], health=False),
    _l("XML", ".xml .props .targets .config .resx", "", [HTML], health=False),
    _l("CSS", ".css", "", [C], [DQ, SQ], health=False),
    _l("SCSS/Less", ".scss .less", "//", [C], [DQ, SQ], health=False),
    _l("Dart", ".dart", "//", [CN], [ESC3D, ESC3S, DQ, SQ]),
    _l("Scala", ".scala .sc", "//", [CN], [RAW3D, DQ], quoted_quote=True),
    _l("R", ".r", "#", (), [DQ, SQ]),
    _l("Lua", ".lua", "--", LUA, [DQ, SQ]),
    _l("Perl", ".pl .pm", "#", POD, [DQ, SQ]),
    _l("Elixir", ".ex .exs", "#", (), [ESC3D, DQ]),
    _l("Haskell", ".hs", "--", [HS], [DQ], quoted_quote=True, operator_aware=True),
    _l("Objective-C", ".m .mm", "//", [C], [DQ, SQ]),
    _l("TOML", ".toml", "#", (), [ESC3D, RAW3S, DQ, SQ], health=False),
    _l("Markdown", ".md .markdown", "", [HTML], health=False),
    _l("Terraform", ".tf .tfvars", "# //", [C], [DQ]),
    _l("Makefile", ".mk .mak Makefile makefile GNUmakefile", "#", (), [DQ, SQ]),
    _l("Dockerfile", ".dockerfile Dockerfile Containerfile", "#", (), [DQ, SQ]),
    _l("CMake", ".cmake CMakeLists.txt", "#", (), [DQ]),
    _l("Groovy", ".groovy .gradle", "//", [C], [ESC3D, ESC3S, DQ, SQ]),
    _l("Julia", ".jl", "#", [Block("#=", "=#", nested=True)], [RAW3D, DQ]),
    _l("Clojure", ".clj .cljs .cljc .edn", ";", (), [DQ]),
    _l("Vue", ".vue", "//", [C, HTML], [TICK, DQ, SQ], regex_literals=True),
    _l("Svelte", ".svelte", "//", [C, HTML], [TICK, DQ, SQ], regex_literals=True),
    _l("Protobuf", ".proto", "//", [C], [DQ, SQ]),
    _l("Batch", ".bat .cmd", "@REM REM ::", (), [DQ], ignore_case=True),
    _l("Assembly", ".asm .s", ";", [C], [DQ, SQ]),
    _l("INI", ".ini .editorconfig", "; #", (), [DQ], health=False),
    _l("Jupyter Notebook", ".ipynb", health=False),
    _l("BASIC", ".bas", "REM '", (), [DQ], ignore_case=True),
    _l("Pascal", ".pas .pp .inc", "//", [Block("{", "}"), Block("(*", "*)")], [DBL_SQ]),
    _l("Zig", ".zig", "//", (), [DQ]),
    _l("Nim", ".nim .nims", "#", [Block("##[", "]##", nested=True), Block("#[", "]#", nested=True)], [RAW3D, DQ]),
    _l("OCaml", ".ml .mli", "", [ML], [DQ], quoted_quote=True),
    _l("Erlang", ".erl .hrl", "%", (), [DQ]),
    _l("Elm", ".elm", "--", [HS], [RAW3D, DQ]),
    _l("Solidity", ".sol", "//", [C], [DQ, SQ]),
    _l("GraphQL", ".graphql .gql", "#", (), [ESC3D, DQ]),
    _l("Bazel/Starlark", ".bzl BUILD BUILD.bazel WORKSPACE WORKSPACE.bazel", "#", (), [ESC3D, ESC3S, DQ, SQ], exact_filenames=True),
    _l("Nix", ".nix", "#", [C], [DQ]),
    _l("Astro", ".astro", "//", [C, HTML], [TICK, DQ, SQ], regex_literals=True),
    _l("MDX", ".mdx", "", [HTML], health=False),
    _l("D", ".d", "//", [C, Block("/+", "+/", nested=True)], [RAW_TICK, DQ, SQ]),
    _l("Crystal", ".cr", "#", (), [DQ, SQ]),
    _l("Razor", ".razor", "//", [RAZOR, HTML, C], [CS_VERBATIM, CS_INTERPOLATED, RAW3D, DQ], health=False, quoted_quote=True),
    _l("XAML", ".xaml .axaml", "", [HTML], health=False),
    _l("Fortran", ".f90 .f95 .f03 .f08 .f .for .f77 .ftn", "!", (), [DBL_DQ, DBL_SQ], health=False),
    _l("COBOL", ".cob .cbl .cobol .cpy", "*>", (), [DBL_DQ, DBL_SQ], health=False),
    _l("Scheme", ".scm .ss .sld", ";", [LISP], [DQ], token_exceptions=LISP_CHARS),
    _l("Racket", ".rkt .rktl .rktd", ";", [LISP], [DQ], token_exceptions=LISP_CHARS),
    _l("Common Lisp", ".lisp .lsp .asd", ";", [LISP], [DQ], token_exceptions=LISP_CHARS),
    _l("Emacs Lisp", ".el", ";", (), [DQ], token_exceptions=('?\\"', '?"', "?\\;")),
    _l("Verilog", ".vh", "//", [C], [DQ]),
    _l("SystemVerilog", ".sv .svh", "//", [C], [DQ]),
    _l("VHDL", ".vhd .vhdl", "--", [C], [DBL_DQ], quoted_quote=True),
    _l("TeX", ".tex .sty", "%", [Block("\\begin{comment}", "\\end{comment}")], health=False, token_exceptions=("\\\\", "\\%")),
    _l("MSBuild script", ".csproj .vbproj .fsproj .vcxproj .wdproj .vcproj .wixproj .btproj .msbuild", "", [HTML], health=False),
    _l("C# Designer", ".designer.cs", "//", [C], CS_QUOTES, health=False),
    _l("Text", ".txt .text", health=False),
)
#: What files of no known language count as, where they are asked for.
OTHER = Language("Other", health=False)
# End of the fixed values.


@lru_cache(maxsize=1)
def by_name() -> dict[str, Language]:
    """Languages by upper-cased display name."""
    return {x.name.upper(): x for x in (*LANGUAGES, OTHER)}


@lru_cache(maxsize=1)
def lookup_tables() -> tuple[dict[str, Language], list[tuple[str, Language]], dict[str, Language]]:
    """File names, suffixes (longest first) and extensions, all upper-cased."""
    names = {n.upper(): x for x in LANGUAGES for n in x.filenames}
    suffixes = sorted(((s.upper(), x) for x in LANGUAGES for s in x.suffixes), key=lambda s: -len(s[0]))
    return names, suffixes, {e.upper(): x for x in LANGUAGES for e in x.extensions}


def resolve(path: str | None) -> Language | None:
    """The language of a file: by exact name, then the longest suffix, then the extension."""
    if not path:
        return None
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    names, suffixes, extensions = lookup_tables()
    found = names.get(name.upper())
    if found and (not found.exact_filenames or name in found.filenames):
        return found
    for suffix, language in suffixes:
        if name.upper().endswith(suffix):
            return language
    dot = name.rfind(".")
    return extensions.get(name[dot:].upper()) if dot >= 0 else None


def by_extension(extension: str | None) -> Language | None:
    """The language of an extension; the leading dot may be missing."""
    if not extension:
        return None
    return lookup_tables()[2].get(("" if extension.startswith(".") else ".") + extension.upper()) or lookup_tables()[2].get(extension.upper())
