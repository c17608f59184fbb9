"""Lines of code, comment and blank, and branch tokens, of a whole text.

Each language becomes a few compiled patterns: one that finds the next token in code,
one per block comment that finds its next token, one per string that matches from its
opening to its end.  A text is cut by them into stretches of code, string and comment;
comment stretches are masked, and the kind of a line follows from what is left of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

from .languages import OTHER, Block, Language, Quote, by_name
from .text import SPACE, decode, normal_ends

#: Stands for a non-blank character of a comment.
MARK = "\x01"
_SOLID = re.compile(f"[^{re.escape(SPACE)}]")
_INK = re.compile(f"[^{re.escape(SPACE)}\n]")
_IDENTIFIER = re.compile(r"\w")
_BRACKETS = re.compile(r"[()\[\]{}]")
_NUMBER = re.compile(r"[\w'.]+\Z")
_WORD_END = re.compile(r"\w+\Z")
_REGEX = re.compile(r"/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\[\n])*+/(?![/*])[A-Za-z]*")
# Symbols of operators, and words before which a slash starts a regular expression.
OPERATORS = "!#$%&*+./<=>?@\\^|-~:"
BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())


class Counts(NamedTuple):
    code: int
    comment: int
    blank: int
    complexity: int | None


@dataclass(frozen=True)
class Scanner:
    """The patterns of one language."""

    language: Language
    token: re.Pattern | None
    groups: tuple[tuple[str, object], ...]
    blocks: dict[Block, re.Pattern]
    quotes: dict[Quote, re.Pattern]
    branch: re.Pattern | None


def _at_start(token: str, block: Block) -> str:
    return ("(?m:^)" if block.line_start else "") + re.escape(token)


def _comment(token: str, language: Language) -> str:
    out = re.escape(token)
    if language.ignore_case:
        out = f"(?i:{out})"
    if token[-1].isalnum():
        out += r"(?!\w)"
    if token[0].isalnum():
        out = r"(?<!\w)" + out
    if language.operator_aware:
        symbols = re.escape(OPERATORS)
        out = f"(?<![{symbols}]){out}(?!{re.escape(token[0])}*+[{symbols}])"
    for veto in language.line_exceptions:
        out = f"(?!{re.escape(veto)}){out}"
    return out


def _opening(quote: Quote, language: Language) -> str:
    out = re.escape(quote.open)
    if language.quoted_quote and quote.open[0] == '"':
        out = r"""(?:(?<!')(?<!'\\)|(?!"'))""" + out
    return out


def _body(quote: Quote) -> str:
    """From behind the opening to behind the close, or to where the string ends without one."""
    close, first = re.escape(quote.close), re.escape(quote.close[0])
    stop = "" if quote.multiline else r"\n"
    parts = [f"[^{first}{re.escape(quote.escape or '')}{stop}]++"]
    if quote.escape:
        parts.append(re.escape(quote.escape) + r"[^\n]")
    if quote.doubled:
        parts.append(close + close)
    parts.append(f"(?!{close})" + (r"[\s\S]" if quote.multiline else r"[^\n]"))
    return f"(?:{'|'.join(parts)})*+(?:{close})?"


@lru_cache(maxsize=128)
def scanner(language: Language) -> Scanner:
    found: list[tuple[str, object, str]] = []
    if language.regex_literals:
        found.append(("slash", None, r"/(?![/*])"))
    found += [("exception", t, re.escape(t)) for t in language.token_exceptions]
    found += [("block", b, _at_start(b.open, b)) for b in language.blocks]
    found += [("line", t, _comment(t, language)) for t in language.line]
    found += [("quote", q, _opening(q, language)) for q in language.quotes]
    blocks = {}
    for b in language.blocks:
        starts = {b.close[0]} | ({b.open[0]} if b.nested else set())
        skip = [re.escape(t) for t in language.token_exceptions if t[0] in starts]
        parts = [f"(?P<skip>{'|'.join(skip)})"] if skip else []
        if b.nested:
            parts.append(f"(?P<open>{_at_start(b.open, b)})")
        blocks[b] = re.compile("|".join([*parts, f"(?P<close>{_at_start(b.close, b)})"]))
    branch = None
    if language.keywords:
        # words are tested for a boundary before them afterwards: patterns that start with letters are searched fast
        words = sorted(language.keywords, key=len, reverse=True)
        branch = re.compile("|".join(rf"{w}\b" if w.isalpha() else re.escape(w) for w in words))
    token = re.compile("|".join(f"({p})" for _, _, p in found)) if found else None
    return Scanner(language, token, tuple((k, x) for k, x, _ in found), blocks, {q: re.compile(_body(q)) for q in language.quotes}, branch)


class _Text:
    """One pass over a text: stretches in order, as (start, end, kind)."""

    def __init__(self, text: str, scan: Scanner):
        self.text, self.scan = text, scan
        self.out: list[tuple[int, int, str]] = []
        self.depth = 0  # open brackets in code, for docstrings
        self.last = -1  # place of the last character of code, for regular expressions
        self.value = False  # a string or regular expression came after it
        self.doc = any(q.doc for q in scan.language.quotes)

    def code(self, start: int, end: int) -> None:
        if start >= end:
            return
        self.out.append((start, end, "code"))
        if self.doc:
            for m in _BRACKETS.finditer(self.text, start, end):
                self.depth = self.depth + 1 if m[0] in "([{" else max(0, self.depth - 1)
        if self.scan.language.regex_literals:
            solid = len(self.text[start:end].rstrip(SPACE + "\n"))
            if solid:
                self.last, self.value = start + solid - 1, False

    def regex_may_start(self) -> bool:
        if self.value:
            return False
        if self.last < 0:
            return True
        before = self.text[self.last]
        if before in ")]\"'`<":
            return False
        if not (before.isalnum() or before in "_$"):
            return True
        line = self.text.rfind("\n", 0, self.last + 1) + 1
        word = _WORD_END.search(self.text, line, self.last + 1)
        if not word or word[0] not in BEFORE_REGEX:
            return False
        return word.start() == line or self.text[word.start() - 1] not in ".$"

    def begins_statement(self, at: int) -> tuple[bool, int]:
        """Whether a doc string may start here, and where its prefix does."""
        line = self.text.rfind("\n", 0, at) + 1
        if self.depth:
            return False, at
        if line:
            above = self.text[self.text.rfind("\n", 0, line - 1) + 1 : line - 1].rstrip(SPACE)
            if above.endswith("\\") and self._is_code(self.text.rfind("\\", 0, line - 1)):
                return False, at
        start = at
        for s, e, kind in reversed(self.out):
            if e <= line:
                break
            if kind in ("code", "string") and _SOLID.search(self.text, max(s, line), min(e, at)):
                start = line
                break
        if start == at:
            return True, at
        before = self.text[line:at].lstrip(SPACE)
        return (True, at - len(before)) if before in self.scan.language.doc_prefixes else (False, at)

    def _is_code(self, place: int) -> bool:
        for s, e, kind in reversed(self.out):
            if s <= place < e:
                return kind == "code"
            if e <= place:
                break
        return False

    def block(self, start: int, block: Block) -> int:
        """The end of a block comment that opens at start."""
        find, level, at = self.scan.blocks[block], 1, start + len(block.open)
        while level:
            m = find.search(self.text, at)
            if not m:
                return len(self.text)
            level += (m.lastgroup == "open") - (m.lastgroup == "close")
            at = m.end()
        return at

    def run(self) -> list[tuple[int, int, str]]:
        text, scan, at = self.text, self.scan, 0
        here = 0  # where the stretch of code began
        if scan.token is None:
            return [(0, len(text), "code")]
        while True:
            m = scan.token.search(text, at)
            if not m:
                break
            kind, what = scan.groups[m.lastindex - 1]
            start = m.start()
            if kind == "slash":
                self.code(here, start)
                here = start
                literal = self.regex_may_start() and _REGEX.match(text, start)
                if literal:
                    self.out.append((start, literal.end(), "string"))
                    self.value = True
                    at = here = literal.end()
                else:  # a division, or markup
                    at = start + 1
                continue
            if kind == "exception":
                at = m.end()
                continue
            if kind == "quote" and scan.language.digit_separators and text[start] == "'":
                number = _NUMBER.search(text, text.rfind("\n", 0, start) + 1, start)
                if number and number[0][0] in "0123456789":
                    at = start + 1
                    continue
            at = here = self._take(kind, what, start, here)
        self.code(here, len(text))
        return self.out

    def _take(self, kind: str, what, start: int, here: int) -> int:
        text = self.text
        if kind == "block":
            self.code(here, start)
            end = self.block(start, what)
            self.out.append((start, end, "comment"))
        elif kind == "line":
            self.code(here, start)
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            self.out.append((start, end, "comment"))
        else:
            self.code(here, start)
            end = self.scan.quotes[what].match(text, start + len(what.open)).end()
            doc, begin = self.begins_statement(start) if what.doc else (False, start)
            if doc and begin < start:  # the prefix belongs to the doc string
                s, e, k = self.out.pop()
                self.out += [(s, begin, k), (begin, start, "prefix")]
            self.out.append((start, end, "doc" if doc else "string"))
            self.value = True
        return end


def classify(text: str, language: Language) -> tuple[list[str], str]:
    """The kind of each line (code, comment or blank), and the code alone: the rest of the text as blanks."""
    if text == "":
        return [], ""
    text = normal_ends(text).replace(MARK, "\x02")
    stretches = _Text(text, scanner(language)).run()
    shown, code = [], []
    for start, end, kind in stretches:
        part = text[start:end]
        masked = kind in ("comment", "doc", "prefix")
        shown.append(_INK.sub(MARK, part) if masked else part)
        code.append(part if kind in ("code", "prefix") else _INK.sub(" ", part))
    kinds = []
    for line in "".join(shown).split("\n"):
        bare = line.strip(SPACE)
        if not bare:
            kinds.append("blank")
        elif MARK in bare and not bare.replace(MARK, "").strip(SPACE):
            kinds.append("comment")
        else:
            kinds.append("code")
    return kinds, "".join(code)


def count(text: str, language: Language | None, complexity: bool = True) -> Counts:
    language = language or OTHER
    kinds, code = classify(text, language)
    branch = scanner(language).branch if complexity else None
    total = None if branch is None else 1 + sum(1 for m in branch.finditer(code) if not (m[0].isalpha() and _IDENTIFIER.match(code, max(0, m.start() - 1), m.start())))
    n = len(kinds)
    comments, blanks = kinds.count("comment"), kinds.count("blank")
    return Counts(n - comments - blanks, comments, blanks, total)


def count_bytes(content: bytes, language: Language | None, complexity: bool = True) -> Counts | None:
    """None for a binary file."""
    text = decode(content)
    return None if text is None else count(text, language, complexity)


def count_named(text: str, name: str | None, complexity: bool = True) -> Counts:
    return count(text, by_name().get((name or "").upper()), complexity)
