"""The options of a run, checked before anything is read."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.analysis import SORTS
from ..operators.filters import unknown_languages
from ..sources.walker import ScanOptions

FORMATS = {".json": "json", ".html": "html", ".htm": "html", ".csv": "csv", ".md": "markdown", ".markdown": "markdown"}
OK, ERROR, THRESHOLD, UNEXPECTED = 0, 1, 2, 3


class OptionError(ValueError):
    """A combination of options that cannot run: exit code 1."""


def output_format(named: str | None, output: str | None) -> str:
    """The format named, else the one of the output's extension, else a table."""
    if named:
        name = {"md": "markdown"}.get(named.lower(), named.lower())
        if name not in (*FORMATS.values(), "table"):
            raise OptionError(f"unknown format: {named}")
        return name
    dot = (output or "").rfind(".")
    return FORMATS.get(output[dot:].lower(), "table") if dot >= 0 else "table"


@dataclass(frozen=True)
class RunOptions:
    path: str = "."
    list_file: str | None = None
    git_hash: str | None = None
    compare_to: str | None = None
    baseline: str | None = None
    scan: ScanOptions = ScanOptions()
    format: str | None = None
    output: str | None = None
    by_file: bool = False
    detailed: bool = False
    no_health: bool = False
    no_complexity: bool = False
    unique: bool = False
    watch: bool = False
    min_comment_pct: float | None = None
    sort: str = "total"
    top: int | None = None

    def check(self) -> RunOptions:
        kind = output_format(self.format, self.output)
        if self.min_comment_pct is not None and not 0 <= self.min_comment_pct <= 100:
            raise OptionError("min-comment-pct must be 0 to 100")
        if self.top is not None and self.top < 1:
            raise OptionError("top must be 1 or more")
        if self.sort.lower() not in SORTS:
            raise OptionError(f"unknown sort: {self.sort}")
        if unknown := unknown_languages([*self.scan.include_langs, *self.scan.exclude_langs]):
            raise OptionError(f"unknown language: {', '.join(unknown)}")
        pairs = [
            ("git-hash", self.git_hash, "list-file", self.list_file), ("compare-to", self.compare_to, "baseline", self.baseline),
            ("compare-to", self.compare_to, "list-file", self.list_file), ("compare-to", self.compare_to, "watch", self.watch),
            ("watch", self.watch, "list-file", self.list_file), ("watch", self.watch, "git-hash", self.git_hash), ("watch", self.watch, "baseline", self.baseline),
        ]
        for a, given, b, also in pairs:
            if given and also:
                raise OptionError(f"{a} does not go with {b}")
        if self.watch and kind != "table":
            raise OptionError("watch shows a table only")
        return self
