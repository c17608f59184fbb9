"""Python data sources: source trees on disk and trees of git commits.

Both list on the driver, where rules prune whole folders, and read contents in the
tasks, a chunk of files each.  Options are strings; lists are separated by '|'.

    register(spark)
    spark.read.format("sourcetree").load("/path")
    spark.read.format("gittree").option("ref", "HEAD~3").load("/path/to/repository")

Rows with a skip_reason tell what was left out; their content is null.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .walker import Listing, ScanOptions, list_paths, list_snapshot, list_tree

SCHEMA = "path string, rel_path string, language string, content binary, scan_ordinal long, skip_reason string"
#: Files and bytes of a partition, about.
CHUNK_FILES, CHUNK_BYTES = 2000, 32 << 20
_FLAGS = ("recursive", "include_unknown", "respect_gitignore", "respect_gitattributes", "follow_symlinks")


def scan_options(options: dict[str, str]) -> ScanOptions:
    given = {k.lower(): v for k, v in options.items()}
    values: dict[str, object] = {}
    for f in fields(ScanOptions):
        if f.name in given:
            text = given[f.name]
            values[f.name] = text.strip().lower() in ("true", "1", "yes") if f.name in _FLAGS else tuple(x for x in text.split("|") if x)
    return ScanOptions(**values)


def option_strings(options: ScanOptions) -> dict[str, str]:
    """The same options for DataFrameReader.options()."""
    return {f.name: str(v).lower() if isinstance(v := getattr(options, f.name), bool) else "|".join(v) for f in fields(ScanOptions)}


@dataclass
class Chunk(InputPartition):
    files: list[tuple[int, str, str, str]]
    skipped: list[tuple[str, str]]


def _chunks(listing: Listing) -> list[Chunk]:
    out, files, size = [], [], 0
    for k, (path, rel, language) in enumerate(listing.files):
        try:
            own = os.stat(path).st_size
        except OSError:
            own = 0
        if files and (len(files) >= CHUNK_FILES or size + own > CHUNK_BYTES):
            out.append(Chunk(files, []))
            files, size = [], 0
        files.append((k, path, rel, language))
        size += own
    if files:
        out.append(Chunk(files, []))
    if listing.skipped or not out:
        out.append(Chunk([], listing.skipped))
    return out


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.given = dict(options)

    def partitions(self) -> list[Chunk]:
        options = scan_options(self.given)
        if self.given.get("filelist"):
            return _chunks(list_paths(self.given["filelist"].split("\n"), options))
        return _chunks(list_tree(self.given["path"], options))

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for k, path, rel, language in partition.files:
            try:
                with open(path, "rb") as file:
                    yield path, rel, language, file.read(), k, None
            except OSError as problem:
                yield path, rel, language, None, k, problem.strerror or str(problem)
        for k, (path, reason) in enumerate(partition.skipped):
            yield path, None, None, None, k, reason


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class GitError(ValueError):
    pass


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return done.stdout


@dataclass(frozen=True)
class Blob:
    path: str
    oid: str
    filtered: bool = False


@dataclass
class Tree:
    top: str
    commit: str
    prefix: str
    blobs: list[Blob]
    skipped: list[tuple[str, str]]


def git_tree(hint: str, ref: str) -> Tree:
    """The files of a commit below the folder (or the file) that hint names, in the order of the tree."""
    if ref.startswith("-"):
        raise GitError(f"not a revision: {ref}")
    folder = hint if os.path.isdir(hint) else os.path.dirname(os.path.abspath(hint))
    top = git(folder, "rev-parse", "--show-toplevel").decode().rstrip("\n")
    commit = git(folder, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").decode().strip()
    prefix = os.path.relpath(os.path.realpath(hint), os.path.realpath(top)).replace(os.sep, "/")
    prefix = "" if prefix == "." else prefix
    blobs, skipped = [], []
    for entry in git(top, "ls-tree", "-r", "-z", "--full-tree", commit, *(["--", prefix] if prefix else [])).split(b"\0"):
        if not entry:
            continue
        head, _, raw = entry.partition(b"\t")
        mode, kind, oid = head.decode().split()
        path = os.fsdecode(raw)
        if mode == "120000":
            skipped.append((path, "symlink"))
        elif kind == "commit":
            skipped.append((path, "submodule"))
        else:
            blobs.append(Blob(path, oid))
    names = b"".join(os.fsencode(b.path) + b"\0" for b in blobs)
    special = set()
    if names:
        words = git(top, "check-attr", "-z", "--stdin", "filter", "working-tree-encoding", data=names).split(b"\0")
        for path, _, value in zip(words[0::3], words[1::3], words[2::3], strict=False):
            if value not in (b"unspecified", b"unset"):
                special.add(os.fsdecode(path))
    return Tree(top, commit, prefix, [Blob(b.path, b.oid, b.path in special) for b in blobs], skipped)


@dataclass
class GitChunk(InputPartition):
    top: str
    commit: str
    files: list[tuple[int, str, str, Blob]]  # ordinal, relative path, language, blob
    skipped: list[tuple[str, str]]


class _GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.given = dict(options)

    def partitions(self) -> list[GitChunk]:
        options = scan_options(self.given)
        tree = git_tree(self.given["path"], self.given.get("ref", "HEAD"))
        by_path = {b.path: b for b in tree.blobs}
        if self.given.get("filters", "false").lower() == "true":  # as a scan of the folder would
            whole = git_tree(tree.top, tree.commit) if tree.prefix else tree
            rules = {b.path: b for b in whole.blobs}
            text = lambda path: git(tree.top, "cat-file", "blob", rules[path].oid).decode("utf-8-sig", "replace")
            wanted = list_snapshot([b.path for b in whole.blobs], options, text, tree.prefix)
        else:
            wanted = [(b.path, language) for b in tree.blobs if (language := options.language(b.path))]
        cut = len(tree.prefix) + 1 if tree.prefix else 0
        files = [(k, path[cut:] if path != tree.prefix else os.path.basename(path), language, by_path[path]) for k, (path, language) in enumerate(wanted)]
        out = [GitChunk(tree.top, tree.commit, files[at : at + CHUNK_FILES], []) for at in range(0, len(files), CHUNK_FILES)]
        return [*out, GitChunk(tree.top, tree.commit, [], tree.skipped)]

    def read(self, partition: GitChunk) -> Iterator[tuple]:
        plain = [f for f in partition.files if not f[3].filtered]
        if plain:
            # requests are written by a thread of their own, so neither side waits for a full pipe
            import threading

            with subprocess.Popen(["git", "-C", partition.top, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as batch:

                def ask() -> None:
                    for f in plain:
                        batch.stdin.write(f[3].oid.encode() + b"\n")
                    batch.stdin.close()

                writer = threading.Thread(target=ask, daemon=True)
                writer.start()
                for k, rel, language, blob in plain:
                    head = batch.stdout.readline().split()
                    if len(head) != 3:
                        yield blob.path, rel, language, None, k, f"git cat-file error: {b' '.join(head).decode(errors='replace')}"
                        continue
                    content = batch.stdout.read(int(head[2]))
                    batch.stdout.read(1)
                    yield blob.path, rel, language, content, k, None
                writer.join()
        for k, rel, language, blob in (f for f in partition.files if f[3].filtered):
            try:
                yield blob.path, rel, language, git(partition.top, "cat-file", "--filters", f"{partition.commit}:{blob.path}"), k, None
            except GitError as problem:
                yield blob.path, rel, language, None, k, f"git checkout filter error: {problem}"
        for k, (path, reason) in enumerate(partition.skipped):
            yield path, None, None, None, k, reason


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gittree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(GitTree)
