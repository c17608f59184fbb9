"""Bytes to text to lines, for Python workers and as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, for str.strip, Python and Java classes, and RE2.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
JAVA_SPACE = r"\t-\r \x85\xA0  -     　"
RE2_SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_ENDS = re.compile(r"\r\n?")


def decode(content: bytes) -> str | None:
    """Text of a file, None for a binary one.

    A byte order mark decides; without one, UTF-8 if valid, else Latin-1.  A NUL makes a
    file binary unless it has a UTF-16 or UTF-32 mark.
    """
    if content.startswith(b"\xfe\xff"):
        return content[2:].decode("utf-16-be", "replace")
    if content.startswith(b"\xff\xfe\x00\x00"):
        return content[4:].decode("utf-32-le", "replace")
    if content.startswith(b"\xff\xfe"):
        return content[2:].decode("utf-16-le", "replace")
    if content.startswith(b"\x00\x00\xfe\xff"):
        return content[4:].decode("utf-32-be", "replace")
    if b"\x00" in content:
        return None
    if content.startswith(b"\xef\xbb\xbf"):
        return content[3:].decode("utf-8", "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def text_lines(text: str) -> list[str]:
    """Lines of a rule or list file: only CR, LF and both together end one."""
    return re.split(r"\r\n|\r|\n", text)


def normal_ends(text: str) -> str:
    """text with line feeds as the only line ends and none after the last line."""
    text = _ENDS.sub("\n", text)
    return text[:-1] if text.endswith("\n") else text


def lines_column(text: Column) -> Column:
    """array<string> of the lines; no line for an empty text, none after a final line end."""
    body = F.regexp_replace(text, r"(\r\n|\r|\n)\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n", -1))


def is_blank(line: Column) -> Column:
    return ~line.rlike(f"[^{JAVA_SPACE}]")


def is_binary(content: Column) -> Column:
    """A NUL byte and no UTF-16 or UTF-32 mark."""
    head = F.hex(F.substring(content, 1, 4))
    marked = head.startswith("FEFF") | head.startswith("FFFE") | head.startswith("0000FEFF")
    return (F.position(F.lit(b"\x00"), content) > 0) & ~marked
