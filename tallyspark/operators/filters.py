"""File selection on relative paths, as Spark columns and as plain functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import LANGUAGES, OTHER, by_name

#: Folders that a scan never enters.
EXCLUDED_DIRS = ("bin", "obj", "artifacts", ".git", ".vs", ".vscode", ".idea", "node_modules")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression for a whole relative path; case does not matter."""
    glob = glob.replace("\\", "/").removeprefix("./").lstrip("/")
    if glob.endswith("/"):
        glob += "**"
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "(?is)^" + "".join(out) + r"\z"


def _any(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(glob_pattern(g)) for g in globs))


def matches_globs(path: str, includes: list[str], excludes: list[str]) -> bool:
    hit = lambda globs: any(re.match(glob_pattern(g).replace(r"\z", r"\Z"), path) for g in globs)
    return (not includes or hit(includes)) and not hit(excludes)


def folder_globs(names: list[str]) -> list[str]:
    return [f"**/{n}/**" for n in names]


def by_globs(files: DataFrame, includes: list[str] = (), excludes: list[str] = (), recursive: bool = True, path: str = "rel_path") -> DataFrame:
    """Files that an include matches (all, without any) and no exclude; root files only unless recursive or included."""
    col = files[path]
    if includes:
        files = files.where(_any(col, list(includes)))
    elif not recursive:
        files = files.where(~col.contains("/"))
    return files.where(~_any(col, list(excludes))) if excludes else files


def outside_excluded_dirs(files: DataFrame, path: str = "rel_path", ignore_case: bool = False) -> DataFrame:
    parts = F.split(F.upper(files[path]) if ignore_case else files[path], "/")
    names = [n.upper() if ignore_case else n for n in EXCLUDED_DIRS]
    return files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, names))) | (F.size(parts) < 2))


def in_scope(files: DataFrame, scope: str, path: str = "rel_path") -> DataFrame:
    """The file that scope names, or the files of the folder that it names."""
    scope = scope.strip("/")
    return files.where((files[path] == scope) | files[path].startswith(scope + "/")) if scope else files


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.create_map().cast("map<string,string>")


def language_column(path: Column) -> Column:
    """The language of a path: by name, then the longest suffix, then the extension; null if unknown."""
    name = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    upper = F.upper(name)
    loose = {n.upper(): x.name for x in LANGUAGES if not x.exact_filenames for n in x.filenames}
    exact = {n: x.name for x in LANGUAGES if x.exact_filenames for n in x.filenames}
    suffix = F.lit(None).cast("string")
    for s, language in sorted(((s, x.name) for x in LANGUAGES for s in x.suffixes), key=lambda p: len(p[0])):
        suffix = F.when(upper.endswith(s.upper()), language).otherwise(suffix)
    extensions = {e.upper(): x.name for x in LANGUAGES for e in x.extensions}
    at = lambda pairs, key: F.try_element_at(_map(pairs), key)
    return F.coalesce(at(loose, upper), at(exact, name), suffix, at(extensions, F.regexp_extract(upper, r"(\.[^.]*)\z", 1)))


def resolve_languages(files: DataFrame, include_unknown: bool = False, path: str = "rel_path") -> DataFrame:
    """files and language; files of unknown languages go, or count as Other."""
    out = files.withColumn("language", language_column(files[path]))
    return out.withColumn("language", F.coalesce("language", F.lit(OTHER.name))) if include_unknown else out.where("language IS NOT NULL")


def by_language(files: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    upper = F.upper("language")
    if include:
        files = files.where(upper.isin([n.upper() for n in include]))
    return files.where(~upper.isin([n.upper() for n in exclude])) if exclude else files


def unknown_languages(names: list[str]) -> list[str]:
    """Those of names that are no display name."""
    return [n for n in names if n.upper() not in by_name()]
