"""Ignore and attribute rules, globs, git settings."""

import pytest

from tallyspark.operators.filters import folder_globs, matches_globs
from tallyspark.sources.gitattributes import AttributeRules
from tallyspark.sources.gitignore import IgnoreRules, config_values, truthy


@pytest.mark.parametrize(
    "lines,path,directory,expected",
    [
        (["*.log"], "a/b.log", False, True), (["/a.log"], "b/a.log", False, False), (["/a.log"], "a.log", False, True), (["a/b"], "x/a/b", False, False), (["a/b"], "a/b", False, True),
        (["build/"], "build", False, False), (["build/"], "build/x", False, True), (["build/"], "x/build/y", False, True), (["*.log", "!keep.log"], "keep.log", False, False),
        (["d/", "!d/keep"], "d/keep", False, True), (["d/*", "!d/keep"], "d/keep", False, False), (["**/x"], "a/b/x", False, True), (["a/**"], "a/b/c", False, True), (["a/**"], "a", True, False),
        (["a/**/b"], "a/b", False, True), (["a/**/b"], "a/x/y/b", False, True), (["a**b"], "axb", False, True), (["a**b"], "ax/b", False, False), (["?.c"], "a.c", False, True), (["?.c"], "ab.c", False, False),
        (["[a-c].x"], "b.x", False, True), (["[!a-c].x"], "b.x", False, False), (["[^a-c].x"], "d.x", False, True), (["[]a].x"], "].x", False, True), (["a[/]b"], "a/b", False, False), (["[z-a]"], "m", False, False),
        (["[a"], "[a", False, False), (["a\\"], "a", False, False), (["\\#a"], "#a", False, True), (["#a"], "#a", False, False), (["\\!a"], "!a", False, True), (["a "], "a", False, True), (["a\\ "], "a ", False, True), (["a\t"], "a", False, False),
        (["\\*"], "*", False, True), (["\\*"], "x", False, False), ([""], "x", False, False), (["/"], "x", False, False), (["[[:digit:]]x"], "1x", False, True),
    ],
)
def test_ignore(lines, path, directory, expected):
    assert IgnoreRules().add("", lines).ignored(path, directory) is expected


def test_ignore_nesting_case_and_exemption():
    rules = IgnoreRules().add("", ["*.py"]).add("a", ["!x.py", "/y"])
    assert not rules.ignored("a/x.py") and rules.ignored("b/x.py") and rules.ignored("a/y") and not rules.ignored("a/b/y")
    assert IgnoreRules(True).add("", ["ABC"]).ignored("abc") and not IgnoreRules().add("", ["ABC"]).ignored("abc")
    top = IgnoreRules().add("", ["sub"])
    assert top.ignored("sub/a.py") and not top.ignored("sub/a.py", exempt=1)


@pytest.mark.parametrize(
    "files,path,expected",
    [
        ({"": ["*.js linguist-vendored"]}, "a.js", True), ({"": ["*.js linguist-vendored=false"]}, "a.js", False), ({"": ["*.js linguist-generated=0"]}, "a.js", False), ({"": ["*.js linguist-generated=yes"]}, "a.js", True),
        ({"": ["*.js -linguist-vendored"]}, "a.js", False), ({"": ["*.js linguist-vendored", "a.js !linguist-vendored"]}, "a.js", False), ({"": ["* linguist-vendored"], "s": ["* -linguist-vendored"]}, "s/a", False),
        ({"": ["v/ linguist-vendored"]}, "v/a/b.c", True), ({"": ["v linguist-vendored"]}, "v/a", False), ({"": ["v/** linguist-vendored"]}, "v/a/b", True), ({"": ["/v linguist-vendored"]}, "x/v", False),
        ({"": ["[attr]third linguist-vendored", "*.js third"]}, "a.js", True), ({"": ["[attr]a b", "[attr]b linguist-generated", "*.js a"]}, "x.js", True), ({"s": ["[attr]third linguist-vendored", "*.js third"]}, "s/a.js", False),
        ({"": ['"a b.js" linguist-vendored']}, "a b.js", True), ({"": ['"\\141.js" linguist-vendored']}, "a.js", True), ({"": ["!*.js linguist-vendored"]}, "a.js", False), ({"": ["*.js linguist-vendored -b@d"]}, "a.js", False),
        ({"": ["*.js linguist-vendored " + "x" * 2048]}, "a.js", False), ({"": ["*.js linguist-vendored -linguist-vendored"]}, "a.js", False), ({"": ["*.js -linguist-vendored linguist-vendored"]}, "a.js", True), ({"": ["# c", "", "*.js builtin_x linguist-vendored"]}, "a.js", False),
    ],
)
def test_attributes(files, path, expected):
    rules = AttributeRules()
    for base, lines in files.items():
        rules.add(base, lines)
    assert rules.marked(path) is expected


@pytest.mark.parametrize(
    "includes,excludes,path,expected",
    [
        ([], [], "a", True), (["**/*.cs"], [], "a.CS", True), (["*.cs"], [], "s/a.cs", False), (["sub/**"], [], "sub/a/b", True), (["**/sub/*.cs"], [], "x/sub/a.cs", True), (["**/sub/*.cs"], [], "sub/a.cs", True),
        (["dir/sub/*.cs"], [], "dir/sub/a.cs", True), ([], ["**/tests/**"], "a/Tests/x", False), (["**/*.cs"], ["**/drop.cs"], "a/drop.cs", False), ([], folder_globs(["gen"]), "gen/a", False), ([], folder_globs(["gen"]), "agen/a", True),
    ],
)
def test_globs(includes, excludes, path, expected):
    assert matches_globs(path, includes, excludes) is expected


def test_settings():
    got = config_values('[core]\n\texcludesFile = "~/a b" ; c\n ignoreCase\n[remote "x"]\nurl=u # c\n[core]\nignorecase = false\n')
    assert got == {"core.excludesfile": "~/a b", "core.ignorecase": "false", "remote.x.url": "u"}
    assert truthy("Yes") and not truthy("off") and not truthy(None)
