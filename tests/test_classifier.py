"""Lines and branch tokens, by language."""

import pytest

from tallyspark.functions.classifier import classify, count, count_named
from tallyspark.functions.languages import LANGUAGES, OTHER, by_extension, by_name, resolve
from tallyspark.functions.text import decode

#: language, text, expected kinds: c code, m comment, b blank.
CASES = [
    ("C#", "int a;\n\n// x\n/* one\n two */\nint b; // y", "cbmmmc"),
    ("C#", "/* a\n\n   \nb */", "mbbm"),
    ("C#", 'var u = "http://x"; \n// y', "cm"),
    ("C#", "/* a /* b */ int c;", "c"),
    ("C#", "/* a */ /* b */", "m"),
    ("C#", '@"one\n// two\n""three""\n" + x; // y\n// z', "ccccm"),
    ("C#", '"""\n// raw\n""";\n// z', "cccm"),
    ("Rust", "/* a /* b */ c */ // d\nlet x = 1;", "mc"),
    ("Rust", "/* a /* b */\nstill */\nlet c = '\"'; // q\n// r", "mmcm"),
    ("Rust", 'let s = r#"a "quoted"\n// in it\n"#;\n// out', "cccm"),
    ("Python", '"""Doc.\n\nmore\n"""\nx = 1', "mbmmc"),
    ("Python", 'x = """\n# text\n"""\n# c', "cccm"),
    ("Python", 'f("""a\n""")\n', "cc"),
    ("Python", 'r"""doc"""\nf"""not"""', "mc"),
    ("Python", 'x = \\\n"""not doc"""', "cc"),
    ("Python", "'''a''' ; x = 1", "c"),
    ("Python", "d = {\n'''key''': 1,\n}\n'''doc'''", "cccm"),
    ("Ruby", "=begin\ntext\n=end\n =begin\nx", "mmmcc"),
    ("Perl", "=pod\ntext # x\n=cut\nmy $x; # y\n# z", "mmmcm"),
    ("Perl", "=head2 T\nx\n=cut", "mmm"),
    ("SQL", "-- a\nselect '--' /* b */\n/* c\n*/", "mcmm"),
    ("PHP", "#[Attr]\n# c\n// d\n$x;", "cmmc"),
    ("Visual Basic", "' a\nREM b\nrem c\nREMOVE x\nx = \"'\" ' y\nxREM", "mmmccc"),
    ("Batch", "@REM a\n@rem b\n:: c\nREM_X\necho", "mmmcc"),
    ("Haskell", "-- a\n--> b\n|-- c\n--- d\n{- a {- b -} c -}\nx -- y\n---| z", "mccmmcc"),
    ("Lua", "--[[ a\nb ]]\n-- c\n--[==[ d ]] e\n]==]\nx", "mmmmmc"),
    ("JavaScript", "x = a / b; // c\ny = /[/*]\"/; // d\nreturn /'/g;\n// e\nz = `\n// in\n`;", "cccmccc"),
    ("JavaScript", "x = y.return / 2 / '// s';\n// c", "cm"),
    ("JavaScript", "x = 4 / 2 /* a */ / 3\n/*\n*/", "cmm"),
    ("Vue", "<div></div> // c\n<!-- a\n-->\n/* b */", "cmmm"),
    ("F#", "let f = (*) 1\n(* a (* b *) (*) *)\n// c", "cmm"),
    ("Scheme", '#\\; x\n#| a #| b |# |#\n; c\n"; s"', "cmmc"),
    ("Emacs Lisp", '?\\" x ; c\n?\\; y\n; z', "ccm"),
    ("TeX", "\\% a\n% b\n\\begin{comment}\nx\n\\end{comment}\n\\\\% c", "cmmmmc"),
    ("Fortran", "x = 'it''s ! no' ! yes\n! c\ny = 'a\\' ! c", "cmc"),
    ("VHDL", "a <= '\"'; -- c\n-- d", "cm"),
    ("C", "int x = 1'000'000; // a\nchar c = '\"'; // b\n// c", "ccm"),
    ("PowerShell", '"a `" # b"\n# c\n<# d\n#>\n\'it\'\'s # x\'', "cmmmc"),
    ("Nim", "##[ a ]##\n#[ b #[ c ]# ]#\n# d\nx", "mmmc"),
    ("Pascal", "{ a\n} x\n(* b *)\n'it''s { no'", "mcmc"),
    ("HTML", "<p>\n<!-- a\n b -->\n@* c *@\n<b>//</b>", "cmmmc"),
    ("Groovy", '"""a \\""" // x\n"""\n// c', "ccm"),
    ("Text", "# a\n\n b", "cbc"),
    ("C#", '"unclosed // x\n// y', "cm"),
    ("Go", "x := `a\n// b\n` // c\n// d", "cccm"),
    ("Razor", "@* a *@\n<!-- b -->\n// c\nx", "mmmc"),
    ("D", "/+ a /+ b +/ c +/\nx", "mc"),
    ("COBOL", "*> a\nDISPLAY 'x *> y'", "mc"),
    ("Clojure", '; a\n(x "; b") ; c', "mc"),
]


@pytest.mark.parametrize("name,text,kinds", CASES)
def test_kinds(name, text, kinds):
    assert "".join({"code": "c", "comment": "m", "blank": "b"}[k] for k in classify(text, by_name()[name.upper()])[0]) == kinds


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a\n", 1), ("a\r\nb\r\n", 2), ("a\rb\r", 2), ("\n", 1), ("\n\n", 2), ("a\r\r\nb", 3), ("a\x0cb\x0b", 1), (" \n", 1)])
def test_line_ends(text, n):
    got = count(text, OTHER)
    assert got.code + got.comment + got.blank == n


@pytest.mark.parametrize(
    "extension,text,expected",
    [
        (".cs", "int x;", 1), (".cs", "", 1), (".cs", "if (a && b) {}\nwhile (c) {}\nforeach (d) {}\ncase 1:", 6), (".cs", "// if\n\"if\"; /* for */", 1),
        (".js", "x = /if&&/;", 1), (".yml", "if: x", None), (".php", "foreach (a) {} if (b) {} elseif (c) {}", 4), (".py", "x = a and b or c\nband = 1", 3),
        (".js", "diff = iff; a ?: b", 2),
    ],
)
def test_complexity(extension, text, expected):
    assert count(text, by_extension(extension)).complexity == expected


@pytest.mark.parametrize(
    "path,name",
    [
        ("a/b.CS", "C#"), ("x.designer.cs", "C# Designer"), ("Makefile", "Makefile"), ("MAKEFILE", "Makefile"), ("BUILD", "Bazel/Starlark"), ("build", None), ("BUILD.bazel", "Bazel/Starlark"),
        (".editorconfig", "INI"), ("a.unknown", None), ("", None), (None, None), ("dir.py/file", None), ("CMakeLists.txt", "CMake"), ("x.txt", "Text"),
    ],
)
def test_resolution(path, name):
    found = resolve(path)
    assert (found.name if found else None) == name


def test_registry():
    assert len(LANGUAGES) == 78 and len({x.name for x in LANGUAGES}) == 78
    assert sum(x.supports_complexity for x in LANGUAGES) == 13
    assert by_extension("py").name == by_extension(".PY").name == "Python" and by_extension("") is None


@pytest.mark.parametrize(
    "content,text",
    [
        (b"a\n", "a\n"), (b"\xef\xbb\xbfa", "a"), ("﻿é".encode("utf-16-le"), "é"), ("﻿é".encode("utf-16-be"), "é"), ("﻿é".encode("utf-32-le"), "é"),
        ("﻿é".encode("utf-32-be"), "é"), (b"caf\xe9", "café"), (b"a\x00b", None), (b"\xef\xbb\xbfa\x00", None), (b"", ""),
    ],
)
def test_decoding(content, text):
    assert decode(content) == text


def test_mark_in_text_is_code():
    assert count_named("\x01\n", "Text").code == 1 and count_named("x", "nothing").code == 1
