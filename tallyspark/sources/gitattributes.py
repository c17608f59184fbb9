"""Attribute rules that mark files as vendored or generated."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from .gitignore import glob_regex

#: The attributes that leave a file out, and the longest line that counts, in bytes.
MARKS = ("linguist-vendored", "linguist-generated")
LONGEST = 2048
_NAME = re.compile(r"[A-Za-z0-9_.][A-Za-z0-9_.\-]*\Z")
_QUOTED = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}

State = tuple[str, bool | str | None]  # name; True set, False unset, None unspecified, or a value


def _unquote(line: str) -> tuple[str, str] | None:
    """A C-quoted pattern and the rest of its line."""
    out, i = bytearray(), 1
    while i < len(line):
        c = line[i]
        if c == '"':
            return out.decode("utf-8", "replace"), line[i + 1 :]
        if c == "\\":
            i += 1
            octal = re.match(r"[0-3][0-7]{2}", line[i : i + 3])
            if octal:
                out.append(int(octal[0], 8))
                i += 3
                continue
            if i >= len(line) or line[i] not in _QUOTED:
                return None
            c = _QUOTED[line[i]]
        out += c.encode()
        i += 1
    return None


def _states(words: list[str]) -> list[State] | None:
    """None if a name is invalid, which voids the line."""
    out: list[State] = []
    for word in words:
        name, value = word, True
        if word[0] in "-!":
            name, value = word[1:], (False if word[0] == "-" else None)
        elif "=" in word:
            name, _, value = word.partition("=")
        if not _NAME.match(name) or name.startswith("builtin_"):
            return None
        out.append((name, value))
    return out


@dataclass(frozen=True)
class Rule:
    regex: re.Pattern
    states: tuple[State, ...]


@dataclass
class AttributeRules:
    """Attribute files with their folders ('' for the root), outermost first."""

    ignore_case: bool = False
    files: list[tuple[str, list[Rule]]] = field(default_factory=list)
    macros: dict[str, list[State]] = field(default_factory=lambda: {"binary": [("diff", False), ("merge", False), ("text", False)]})

    def add(self, base: str, lines: Iterable[str], top_level: bool | None = None) -> AttributeRules:
        base = base.strip("/")
        top_level = base == "" if top_level is None else top_level
        rules = []
        for raw in lines:
            line = raw.rstrip("\r\n").lstrip(" \t\r")
            if not line or line.startswith("#") or len(raw.encode()) >= LONGEST:
                continue
            if line.startswith("[attr]"):
                name, *words = line[6:].split() or [""]
                states = _states(words)
                if top_level and states is not None and _NAME.match(name) and not name.startswith("builtin_"):
                    self.macros[name] = states
                continue
            if line.startswith('"') and (found := _unquote(line)):
                glob, rest = found
            else:
                glob, _, rest = line.replace("\t", " ").partition(" ")
            states = _states(rest.split())
            if glob.startswith("!") or not states:
                continue
            regex = self._compile(glob)
            if regex:
                rules.append(Rule(regex, tuple(states)))
        if rules:
            self.files.append((base, rules))
        return self

    def _compile(self, glob: str) -> re.Pattern | None:
        folder = glob.endswith("/")
        glob = glob.rstrip("/") if folder else glob
        body = glob_regex(glob.removeprefix("/"))
        if not glob or body is None:
            return None
        # a pattern for folders covers what has that name and the files beneath it
        tail = "(?:/.*)?" if folder else ""
        try:
            return re.compile(("" if "/" in glob else "(?:.*/)?") + body + tail + r"\Z", re.DOTALL | (re.IGNORECASE if self.ignore_case else 0))
        except re.error:
            return None

    def _spread(self, states: Iterable[State], found: dict[str, bool | str | None], seen: frozenset[str] = frozenset()) -> None:
        """Record undecided attributes, the rightmost first; a macro that is set brings its own."""
        for name, value in reversed(list(states)):
            if name not in found:
                found[name] = value
                if value is True and name in self.macros and name not in seen:
                    self._spread(self.macros[name], found, seen | {name})

    def attributes(self, path: str) -> dict[str, bool | str | None]:
        path = path.strip("/")
        found: dict[str, bool | str | None] = {}
        for base, rules in reversed(self.files):
            if base and not path.startswith(base + "/"):
                continue
            rest = path[len(base) + 1 :] if base else path
            for rule in reversed(rules):
                if rule.regex.match(rest):
                    self._spread(rule.states, found)
        return found

    def marked(self, path: str) -> bool:
        """Whether the file is vendored or generated: set, or any value but false and 0."""
        found = self.attributes(path)
        return any(v is True or (isinstance(v, str) and v.lower() not in ("false", "0")) for v in (found.get(m) for m in MARKS))
