"""Listing of a source tree on the driver: which files a scan takes, in which order."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.languages import OTHER, resolve
from ..operators.filters import EXCLUDED_DIRS, folder_globs, matches_globs
from ..functions.text import text_lines
from .gitattributes import AttributeRules
from .gitignore import IgnoreRules, config_values, truthy

MOST_HOPS = 40


@dataclass(frozen=True)
class ScanOptions:
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = ()
    include_langs: tuple[str, ...] = ()
    exclude_langs: tuple[str, ...] = ()
    recursive: bool = True
    include_unknown: bool = False
    respect_gitignore: bool = True
    respect_gitattributes: bool = True
    follow_symlinks: bool = False

    @property
    def all_excludes(self) -> list[str]:
        return [*self.excludes, *folder_globs(list(self.exclude_dirs))]

    def language(self, path: str) -> str | None:
        """The language name of a file that the language filters take."""
        found = resolve(path) or (OTHER if self.include_unknown else None)
        if not found:
            return None
        upper = found.name.upper()
        if self.include_langs and upper not in {n.upper() for n in self.include_langs}:
            return None
        return None if upper in {n.upper() for n in self.exclude_langs} else found.name

    def takes(self, rel_path: str) -> bool:
        """Globs and depth; a root-only scan still goes down for includes."""
        if not self.recursive and not self.includes and "/" in rel_path:
            return False
        return matches_globs(rel_path, list(self.includes), self.all_excludes)


@dataclass
class Listing:
    files: list[tuple[str, str, str]] = field(default_factory=list)  # path, relative path, language
    skipped: list[tuple[str, str]] = field(default_factory=list)  # path, reason


def work_tree(start: Path) -> tuple[Path, Path] | None:
    """(root of the work tree, git folder) around a folder, if it is a repository."""
    for folder in (start, *start.parents):
        dot = folder / ".git"
        git = None
        if dot.is_dir():
            git = dot
        elif dot.is_file() and (text := dot.read_text(errors="replace").strip()).startswith("gitdir:"):
            git = (folder / text[7:].strip()).resolve()
        if git and is_repository(git):
            return folder, git
    return None


def common_dir(git: Path) -> Path:
    named = git / "commondir"
    return (git / named.read_text().strip()).resolve() if named.is_file() else git


def is_repository(git: Path) -> bool:
    shared = common_dir(git)
    return (git / "HEAD").exists() and (shared / "objects").is_dir() and (shared / "refs").is_dir()


def read_config(git: Path | None) -> dict[str, str | None]:
    """Settings of the user, then of the repository."""
    home = Path(os.environ.get("HOME", "/"))
    xdg = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config")
    places = [Path(os.environ["GIT_CONFIG_GLOBAL"])] if os.environ.get("GIT_CONFIG_GLOBAL") else [xdg / "git/config", home / ".gitconfig"]
    out: dict[str, str | None] = {}
    for place in [*places, *([common_dir(git) / "config"] if git else [])]:
        out |= config_values(text) if (text := _read(place)) is not None else {}
    return out


def _read(path: Path) -> str | None:
    try:
        return path.read_text(encoding="utf-8-sig", errors="replace")
    except OSError:
        return None


def initial_rules(root: Path, options: ScanOptions) -> tuple[IgnoreRules | None, AttributeRules | None, Path, bool]:
    """Rules from outside the scan root, the folder that rule paths start at, and whether that is a repository."""
    found = work_tree(root)
    top, git = found or (root, None)
    config = read_config(git)
    fold = truthy(config.get("core.ignorecase"))
    ignore = IgnoreRules(fold) if options.respect_gitignore else None
    attributes = AttributeRules(fold) if options.respect_gitattributes else None
    home = Path(os.environ.get("HOME", "/"))
    if ignore is not None and git:
        named = config.get("core.excludesfile")
        xdg = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config") / "git/ignore"
        everywhere = Path(os.path.expanduser(named)) if named else xdg
        for place in (everywhere, common_dir(git) / "info/exclude"):
            ignore.add("", text_lines(_read(place) or ""))
    above = [p for p in reversed(root.parents) if p == top or top in p.parents] if root != top else []
    for folder in above:
        base = "" if folder == top else folder.relative_to(top).as_posix()
        add_rules(ignore, attributes, base, lambda name, f=folder: _read(f / name))
    return ignore, attributes, top, git is not None


def add_rules(ignore: IgnoreRules | None, attributes: AttributeRules | None, base: str, read: Callable[[str], str | None]) -> None:
    if ignore is not None and (text := read(".gitignore")) is not None:
        ignore.add(base, text_lines(text))
    if attributes is not None and (text := read(".gitattributes")) is not None:
        attributes.add(base, text_lines(text))


def list_tree(root: str, options: ScanOptions) -> Listing:
    """Files below root in the order of their full paths; a root that is a file gives itself."""
    start = Path(os.path.abspath(root))
    if start.is_file():
        return _list_file(start, options)
    out = Listing()
    if not start.is_dir():
        out.skipped.append((str(start), "not found"))
        return out
    ignore, attributes, top, repository = initial_rules(start, options)
    prefix = "" if start == top else start.relative_to(top).as_posix()
    exempt = len(prefix.split("/")) if prefix else 0
    candidates: list[tuple[str, str, str]] = []
    visited = {os.path.realpath(start)}

    def enter(folder: Path, rel: str, real_chain: tuple[str, ...]) -> None:
        base = "/".join(x for x in (prefix, rel) if x)
        add_rules(ignore, attributes, base, lambda name: _read(folder / name))
        try:
            entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
        except OSError as problem:
            out.skipped.append((str(folder), problem.strerror or str(problem)))
            return
        for e in entries:
            own = f"{rel}/{e.name}" if rel else e.name
            full = f"{prefix}/{own}" if prefix else own
            link = e.is_symlink()
            if link and not options.follow_symlinks:
                continue
            try:
                real = os.path.realpath(e.path, strict=link)
                directory = e.is_dir()
            except OSError as problem:
                out.skipped.append((e.path, problem.strerror or str(problem)))
                continue
            if link and (real in real_chain or len(real_chain) > MOST_HOPS or real == str(start) or real.startswith(str(start) + os.sep)):
                continue
            if directory:
                if e.name in EXCLUDED_DIRS or (ignore is not None and ignore.ignored(full, True, exempt)) or (not options.recursive and not options.includes):
                    continue
                if link:
                    if real in visited:
                        continue
                    visited.add(real)
                if repository and ignore is not None and (nested := work_tree(Path(e.path))) and nested[0] == Path(e.path):
                    out.skipped.append((e.path, "nested git repository (submodule)"))
                    continue
                enter(Path(e.path), own, (*real_chain, real))
            elif e.is_file():
                if link:
                    if real in visited:
                        continue
                    visited.add(real)
                candidates.append((e.path, own, full))

    enter(start, "", (os.path.realpath(start),))
    for path, own, full in candidates:
        if not options.takes(own) or (ignore is not None and ignore.ignored(full, False, exempt)) or (attributes is not None and attributes.marked(full)):
            continue
        language = options.language(own)
        if language:
            out.files.append((path, own, language))
    out.files.sort(key=lambda f: os.fsencode(f[0]))
    return out


def _list_file(path: Path, options: ScanOptions) -> Listing:
    """A single file: rules of its folder and those above; globs may match its name or its path from here."""
    ignore, attributes, top, _ = initial_rules(path.parent, options)
    base = "" if path.parent == top else path.parent.relative_to(top).as_posix()
    add_rules(ignore, attributes, base, lambda name: _read(path.parent / name))
    full = f"{base}/{path.name}" if base else path.name
    exempt = len(base.split("/")) if base else 0
    here = os.path.relpath(path).replace(os.sep, "/")
    globs = [matches_globs(x, list(options.includes), []) for x in (path.name, here)]
    dropped = [not matches_globs(x, [], options.all_excludes) for x in (path.name, here)]
    language = options.language(path.name)
    out = Listing()
    if language and any(globs) and not any(dropped) and not (ignore and ignore.ignored(full, False, exempt)) and not (attributes and attributes.marked(full)):
        out.files.append((str(path), path.name, language))
    return out


def list_paths(paths: Iterable[str], options: ScanOptions) -> Listing:
    """Given files in their order, the first of each full path; only language filters apply."""
    out, seen = Listing(), set()
    for given in paths:
        full = os.path.abspath(given)
        if full in seen:
            continue
        seen.add(full)
        if not os.path.isfile(full):
            out.skipped.append((given, "not found"))
        elif language := options.language(full):
            out.files.append((full, os.path.relpath(full).replace(os.sep, "/"), language))
    return out


def read_list(text: str) -> list[str]:
    """Paths of a list file, one to a line; blank lines do not count."""
    return [x for x in text_lines(text.removeprefix("﻿")) if x.strip()]


def list_snapshot(entries: Iterable[str], options: ScanOptions, read: Callable[[str], str | None], scope: str = "", ignore_case: bool = False) -> list[tuple[str, str]]:
    """(path, language) of entries of a snapshot that a scan of the folder scope would take, by path.

    read gives the text of a rule file of the snapshot.
    """
    paths = sorted(entries, key=os.fsencode)
    ignore = IgnoreRules(ignore_case) if options.respect_gitignore else None
    attributes = AttributeRules(ignore_case) if options.respect_gitattributes else None
    names = {p for p in paths if p.rsplit("/", 1)[-1] in (".gitignore", ".gitattributes")}
    scope = scope.strip("/")
    exempt = len(scope.split("/")) if scope else 0
    for folder in sorted({p.rpartition("/")[0] for p in names}, key=lambda f: (f.count("/") + bool(f), f)):
        if any(part in EXCLUDED_DIRS for part in folder.split("/")) or (ignore is not None and folder and folder.count("/") + 1 > exempt and ignore.ignored(folder, True, exempt)):
            continue
        at = lambda name, f=folder: (read(p) if (p := f"{f}/{name}" if f else name) in names else None)
        add_rules(ignore, attributes, folder, at)
    out = []
    for path in paths:
        if scope and path != scope and not path.startswith(scope + "/"):
            continue
        own = path[len(scope) + 1 :] if scope and path != scope else path
        if any(part in EXCLUDED_DIRS for part in own.split("/")[:-1]) or not options.takes(own):
            continue
        if (ignore is not None and ignore.ignored(path, False, exempt)) or (attributes is not None and attributes.marked(path)):
            continue
        if language := options.language(path):
            out.append((path, language))
    return out
