"""Ignore rules: pattern files from the outermost to the innermost, last match wins."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..functions.text import text_lines


def glob_regex(glob: str) -> str | None:
    """A pattern's glob as a regular expression; None if it can match nothing."""
    out, i, n = [], 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "\\":
            if i + 1 == n:
                return None
            out.append(re.escape(glob[i + 1]))
            i += 2
        elif c == "*":
            end = i
            while end < n and glob[end] == "*":
                end += 1
            alone = end - i == 2 and (i == 0 or glob[i - 1] == "/")
            if alone and end < n and glob[end] == "/":
                out.append("(?:.*/)?")
                end += 1
            elif alone and end == n:
                out.append(".*")
            else:
                out.append("[^/]*")
            i = end
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            found = _char_class(glob, i)
            if found is None:
                return None
            text, i = found
            out.append(text)
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def _char_class(glob: str, start: int) -> tuple[str, int] | None:
    """A bracket expression and where it ends; a slash is never a member."""
    i = start + 1
    negated = i < len(glob) and glob[i] in "!^"
    i += negated
    members, first = [], True
    while i < len(glob) and (glob[i] != "]" or first):
        first = False
        if glob.startswith("[:", i) and (end := glob.find(":]", i)) > 0:
            name = glob[i + 2 : end]
            kinds = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "xdigit": "0-9a-fA-F", "punct": re.escape("!\"#$%&'()*+,-.:;<=>?@[\\]^_`{|}~"), "blank": " \\t"}
            if name not in kinds:
                return None
            members.append(kinds[name])
            i = end + 2
            continue
        if glob[i] == "\\":
            i += 1
            if i == len(glob):
                return None
        low = glob[i]
        i += 1
        if glob.startswith("-", i) and i + 1 < len(glob) and glob[i + 1] != "]":
            i += 1
            if glob[i] == "\\":
                i += 1
                if i == len(glob):
                    return None
            high = glob[i]
            i += 1
            if high < low:
                return None
            members.append(f"{re.escape(low)}-{re.escape(high)}")
        else:
            members.append(re.escape(low))
    if i >= len(glob):
        return None
    body = "".join(members)
    return (f"(?!/)[^{body}]" if negated else f"(?!/)[{body}]"), i + 1


@dataclass(frozen=True)
class Pattern:
    regex: re.Pattern
    negated: bool
    directory_only: bool

    @classmethod
    def parse(cls, line: str, ignore_case: bool = False) -> Pattern | None:
        line = line.rstrip("\r\n")
        if not line or line.startswith("#"):
            return None
        end = len(line)
        while end and line[end - 1] == " " and not _escaped(line, end - 1):
            end -= 1
        line = line[:end]
        negated = line.startswith("!")
        line = line[negated:]
        directory_only = line.endswith("/") and not _escaped(line, len(line) - 1)
        line = line[:-1] if directory_only else line
        if not line:
            return None
        anchored = "/" in line
        body = glob_regex(line.removeprefix("/"))
        if body is None:
            return None
        try:
            compiled = re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z", re.DOTALL | (re.IGNORECASE if ignore_case else 0))
        except re.error:
            return None
        return cls(compiled, negated, directory_only)


def _escaped(line: str, at: int) -> bool:
    """Whether an odd number of backslashes stands before the place."""
    n = 0
    while at - n > 0 and line[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


@dataclass
class IgnoreRules:
    """Pattern files with their folders ('' for the root), outermost first."""

    ignore_case: bool = False
    files: list[tuple[str, list[Pattern]]] = field(default_factory=list)
    _known: dict[str, bool] = field(default_factory=dict)

    def add(self, base: str, lines: Iterable[str]) -> IgnoreRules:
        found = [p for p in (Pattern.parse(x, self.ignore_case) for x in lines) if p]
        if found:
            self.files.append((base.strip("/"), found))
            self._known.clear()
        return self

    def _decide(self, path: str, directory: bool) -> bool:
        for base, patterns in reversed(self.files):
            if base and not path.startswith(base + "/"):
                continue
            rest = path[len(base) + 1 :] if base else path
            for p in reversed(patterns):
                if (directory or not p.directory_only) and p.regex.match(rest):
                    return not p.negated
        return False

    def ignored(self, path: str, directory: bool = False, exempt: int = 0) -> bool:
        """Whether a path below the root is ignored, by itself or by a folder above it.

        The first exempt folders (a scan's root and what is above it) never are.
        """
        parts = path.strip("/").split("/")
        for k in range(1 + exempt, len(parts)):
            folder = "/".join(parts[:k])
            if folder not in self._known:
                self._known[folder] = self._decide(folder, True)
            if self._known[folder]:
                return True
        return self._decide("/".join(parts), directory)


def config_values(text: str) -> dict[str, str | None]:
    """section.key -> value of a git configuration text; the last one wins, includes are not followed."""
    out: dict[str, str | None] = {}
    section = ""
    for line in text_lines(re.sub(r"\\\r?\n", "", text)):
        line = line.strip()
        if line.startswith("["):
            head, _, line = line[1:].partition("]")
            name, _, sub = head.partition(" ")
            section = name.strip().lower() + (("." + sub.strip().strip('"')) if sub else "")
            line = line.strip()
        if not line or line[0] in "#;":
            continue
        key, eq, value = line.partition("=")
        out[f"{section}.{key.strip().lower()}"] = _config_text(value) if eq else None
    return out


def _config_text(value: str) -> str:
    out, quoted, i, kept = [], False, 0, 0
    value = value.strip()
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value):
            out.append({"n": "\n", "t": "\t", "b": "\b"}.get(value[i + 1], value[i + 1]))
            i += 2
            kept = len(out)
            continue
        if c == '"':
            quoted = not quoted
        elif c in "#;" and not quoted:
            break
        else:
            out.append(c)
            if quoted or not c.isspace():
                kept = len(out)
        i += 1
    return "".join(out[:kept])


def truthy(value: str | None, missing: bool = False) -> bool:
    """A configuration flag; a key without a value is true."""
    return missing if value is None else value.strip().lower() in ("true", "yes", "on", "1")
