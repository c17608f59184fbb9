"""Reports as JSON, CSV, Markdown, HTML and plain tables.

A report is small (languages, and files if asked for), so it is collected once and
written by the driver.
"""

from __future__ import annotations

import html
import json
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

#: First characters that spreadsheets take for a formula, and characters that Markdown would read.
FORMULA = "=+-@\t\r"
MARKDOWN = "\\`*_[]<>&~|"
MEASURES = ("code", "comment", "blank", "total")


@dataclass
class Report:
    totals: dict
    languages: list[dict]
    files: list[dict] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    generated_at: str = ""
    source: str | None = None
    by_file: bool = False
    detailed: bool = False
    no_health: bool = False
    no_complexity: bool = False

    @property
    def truncated(self) -> bool:
        return len(self.languages) < self.totals["languages"]

    @property
    def note(self) -> str | None:
        return f"Showing top {len(self.languages)} of {self.totals['languages']} languages; totals cover all languages." if self.truncated else None

    @property
    def shows_languages(self) -> bool:
        return self.detailed or not self.by_file

    @property
    def shows_files(self) -> bool:
        return self.detailed or self.by_file


def share(part: int, total: int) -> float:
    """Percent with one decimal, halves away from zero."""
    return float(Decimal(part / total * 100).quantize(Decimal("0.1"), ROUND_HALF_UP)) if total else 0.0


def _entry(row: dict, names: dict[str, str], report: Report) -> dict:
    out = {to: row[of] for of, to in names.items()}
    for m in MEASURES:
        out[m] = row[m]
        if m != "total":
            out[f"{m}Pct"] = share(row[m], row["total"])
    if not report.no_health and row.get("health") not in (None, "NotApplicable"):
        out["health"] = row["health"]
    if not report.no_complexity:
        out["complexity"] = row.get("complexity")
    return {k: v for k, v in out.items() if v is not None}


def to_json(report: Report) -> str:
    body: dict = {"generatedAt": report.generated_at, "sourcePath": report.source, "fileCount": report.totals["files"]}
    body |= _entry({**report.totals, "health": None}, {}, report)
    if report.shows_languages:
        body["byLanguage"] = [_entry(x, {"language": "language", "files": "files"}, report) for x in report.languages]
        if report.truncated:
            body |= {"byLanguageTruncated": True, "languageCount": report.totals["languages"]}
    if report.shows_files:
        body["files"] = [_entry(x, {"path": "path", "language": "language"}, report) for x in report.files]
    body["skipped"] = [{"path": p, "reason": r} for p, r in report.skipped]
    return json.dumps({k: v for k, v in body.items() if v is not None}, indent=2, ensure_ascii=False) + "\n"


def diff_json(total: dict, languages: list[dict]) -> str:
    pick = lambda row: {m: row[m] for m in MEASURES}
    return json.dumps({"total": pick(total), "byLanguage": [{"language": x["language"], **pick(x)} for x in languages]}, indent=2, ensure_ascii=False) + "\n"


def _header(report: Report, files: bool) -> list[str]:
    first = ["Path", "Language"] if files else ["Language", "Files"]
    return [*first, "Code", "Comment", "Blank", "Total", *([] if report.no_health else ["Health"]), *([] if report.no_complexity else ["Complexity"])]


def _cells(report: Report, row: dict, first: list[str], number) -> list[str]:
    level = row.get("health")
    out = [*first, *(number(row[m]) for m in MEASURES)]
    if not report.no_health:
        out.append("" if level in (None, "NotApplicable") else level)
    if not report.no_complexity:
        out.append("" if row.get("complexity") is None else number(row["complexity"]))
    return out


def _table(report: Report, files: bool, number, text=lambda x: x) -> list[list[str]]:
    if files:
        rows = [_cells(report, x, [text(x["path"]), text(x["language"])], number) for x in report.files]
    else:
        rows = [_cells(report, x, [text(x["language"]), number(x["files"])], number) for x in report.languages]
    return rows


def _total(report: Report, files: bool, number, label: str) -> list[str]:
    return _cells(report, {**report.totals, "health": None}, [label, "" if files else number(report.totals["files"])], number)


def csv_field(text: str) -> str:
    if text and text[0] in FORMULA:
        text = "'" + text
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def to_csv(report: Report) -> str:
    """One table of a fixed width: files only if asked for alone."""
    files = report.by_file and not report.detailed
    header = _header(report, files)
    rows = [header, *_table(report, files, str), _total(report, files, str, "Total")]
    line = lambda cells: ",".join(map(csv_field, cells)) + "\r\n"
    out = "".join(map(line, rows))
    if report.skipped:
        wide = [""] * (len(header) - 2)
        out += "\r\n" + line(["Path", "Reason", *wide]) + "".join(line([p, r, *wide]) for p, r in report.skipped)
    return out


def escape_markdown(text: str) -> str:
    return "".join(" " if c in "\r\n" else "\\" + c if c in MARKDOWN else c for c in text)


def to_markdown(report: Report) -> str:
    number = "{:,}".format
    source = f" | **Source:** {escape_markdown(report.source)}" if report.source else ""
    out = ["# Source Line Report", "", f"**Generated:** {report.generated_at} | **Files:** {number(report.totals['files'])} | **Total Lines:** {number(report.totals['total'])}{source}", ""]

    def table(files: bool) -> None:
        header = _header(report, files)
        aligned = [":---", ":---" if files else "---:", *["---:"] * 4, *([] if report.no_health else [":---"]), *([] if report.no_complexity else ["---:"])]
        for cells in (header, aligned, *_table(report, files, number, escape_markdown), _total(report, files, number, "**Total**")):
            out.append("| " + " | ".join(cells) + " |")

    if report.shows_languages:
        if report.detailed:
            out.extend(["## By Language", ""])
        table(False)
        if report.note:
            out.extend(["", f"_{report.note}_"])
    if report.shows_files:
        if report.detailed:
            out.extend(["", "## By File", ""])
        table(True)
    if report.skipped:
        out.extend(["", "## Skipped", "", *(f"- {escape_markdown(p)} — {escape_markdown(r)}" for p, r in report.skipped)])
    return "\n".join(out) + "\n"


def folder_tree(folders: list[dict]) -> list[tuple[int, str, dict]]:
    """(depth, label, row) of folders for display: chains of single folders without files of their own become one.

    folders: rows of the rollup with folder and files.  The root shows only if it holds files itself.
    """
    rows = {f["folder"]: f for f in folders}
    below: dict[str, list[str]] = {}
    for name in rows:
        if name:
            below.setdefault(name.rpartition("/")[0], []).append(name)
    own = {name: row["files"] - sum(rows[c]["files"] for c in below.get(name, [])) for name, row in rows.items()}
    out: list[tuple[int, str, dict]] = []

    def show(name: str, depth: int, above: str) -> None:
        while not own[name] and len(below.get(name, [])) == 1:
            name = below[name][0]
        out.append((depth, name[len(above) :].lstrip("/"), rows[name]))
        for child in sorted(below.get(name, []), key=str.upper):
            show(child, depth + 1, name)

    if "" in rows:
        depth = 0
        if own[""]:
            out.append((0, "(root)", rows[""]))
            depth = 1
        for child in sorted(below.get("", []), key=str.upper):
            show(child, depth, "")
    return out


def to_html(report: Report, folders: list[dict] = ()) -> str:
    number = "{:,}".format
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"

    def table(files: bool) -> str:
        return "<table>" + row(_header(report, files), "th") + "".join(map(row, _table(report, files, number))) + row(_total(report, files, number, "Total")) + "</table>"

    parts = []
    if report.shows_languages:
        parts += ["<h2>By Language</h2>", table(False), *([f"<p>{html.escape(report.note)}</p>"] if report.note else [])]
    if report.shows_files:
        parts += ["<h2>By File</h2>", table(True)]
    if folders:
        head = row(["Folder", "Files", "Code", "Comment", "Blank", "Total", *([] if report.no_health else ["Health"]), *([] if report.no_complexity else ["Complexity"])], "th")
        body = "".join(row(_cells(report, r, ["  " * depth + label, number(r["files"])], number)) for depth, label, r in folder_tree(list(folders)))
        parts += ["<h2>Folders</h2>", f"<table>{head}{body}</table>"]
    if report.skipped:
        parts += ["<h2>Skipped</h2>", "<ul>" + "".join(f"<li>{html.escape(p)}: {html.escape(r)}</li>" for p, r in report.skipped) + "</ul>"]
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:right}td:first-child,th:first-child{text-align:left;white-space:pre}"
    source = f" of {html.escape(report.source)}" if report.source else ""
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Source Line Report</title><style>{style}</style></head><body>'
        f"<h1>Source Line Report</h1><p>{html.escape(report.generated_at)}{source}: {number(report.totals['files'])} files, {number(report.totals['total'])} lines</p>{''.join(parts)}</body></html>\n"
    )


def to_table(report: Report) -> str:
    number = "{:,}".format
    out = []
    for files in ([False] if report.shows_languages else []) + ([True] if report.shows_files else []):
        rows = [_header(report, files), *_table(report, files, number), _total(report, files, number, "Total")]
        width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
        out += ["  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, width, strict=True))) for r in rows] + [""]
    if report.note:
        out.append(report.note)
    return "\n".join(out + [f"skipped {p}: {r}" for p, r in report.skipped]) + "\n"


def signed(n: int) -> str:
    return f"{n:+,}" if n else "0"


def diff_table(total: dict, languages: list[dict]) -> str:
    rows = [["Language", *(m.title() for m in MEASURES)], *([x["language"], *(signed(x[m]) for m in MEASURES)] for x in languages), ["Total", *(signed(total[m]) for m in MEASURES)]]
    width = [max(len(r[i]) for r in rows) for i in range(5)]
    return "\n".join("  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, width, strict=True))) for r in rows) + "\n"


def write(text: str, path: str) -> None:
    """UTF-8 without a mark, line ends as they are."""
    with open(path, "w", encoding="utf-8", newline="") as file:
        file.write(text)


RENDERERS = {"json": to_json, "csv": to_csv, "markdown": to_markdown, "html": to_html, "table": to_table}
