"""Sources, aggregates, comparison, reports, options and the watch, on small inputs."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import analysis, diff
from tallyspark.plans import catalog, job
from tallyspark.plans.options import ERROR, OK, THRESHOLD, OptionError, RunOptions, output_format
from tallyspark.sinks import reports
from tallyspark.sources.datasource import register
from tallyspark.sources.walker import ScanOptions, list_paths, list_snapshot, list_tree, read_list
from tallyspark.streaming.watch import RetryState


def _git(folder, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "t", "GIT_AUTHOR_EMAIL": "t@t", "GIT_COMMITTER_NAME": "t", "GIT_COMMITTER_EMAIL": "t@t", "GIT_CONFIG_GLOBAL": "/dev/null"}
    return subprocess.run(["git", "-C", str(folder), *args], env=env, check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    _git(root, "init", "-q")
    catalog.write_tree(str(root))
    _git(root, "add", "-A")
    _git(root, "add", "-f", "out/o.py")
    _git(root, "commit", "-qm", "one")
    return root


EXPECTED = {".editorconfig", ".hid/.d.py", "_p.scss", "a.py", "src/b.cs"}


def test_tree_listing(repo):
    got = list_tree(str(repo), ScanOptions())
    assert {f[1] for f in got.files} == EXPECTED and [f[1] for f in got.files] == sorted(f[1] for f in got.files)
    names = lambda **o: {f[1] for f in list_tree(str(repo), ScanOptions(**o)).files}
    assert names(respect_gitignore=False) == EXPECTED | {"out/o.py"}
    assert names(respect_gitattributes=False) == EXPECTED | {"gen/g.cs", "vendor/v.js"}
    assert names(recursive=False) == {".editorconfig", "_p.scss", "a.py"}
    assert names(recursive=False, includes=("src/**",)) == {"src/b.cs"}
    assert names(include_langs=("python",)) == {".hid/.d.py", "a.py"} and names(exclude_langs=("PYTHON",)) == EXPECTED - {".hid/.d.py", "a.py"}
    assert names(exclude_dirs=("src",)) == EXPECTED - {"src/b.cs"}
    assert "src/skip.log" in names(include_unknown=True)


def test_links_and_nested_repositories(repo, tmp_path):
    outside = tmp_path / "other"
    outside.mkdir()
    (outside / "l.py").write_text("x")
    (repo / "link").symlink_to(outside)
    (repo / "again").symlink_to(outside)
    (repo / "loop").symlink_to(repo)
    assert {f[1] for f in list_tree(str(repo), ScanOptions()).files} == EXPECTED
    followed = {f[1] for f in list_tree(str(repo), ScanOptions(follow_symlinks=True)).files}
    assert followed == EXPECTED | {"again/l.py"}
    inner = repo / "sub"
    inner.mkdir()
    _git(inner, "init", "-q")
    (inner / "s.py").write_text("x")
    got = list_tree(str(repo), ScanOptions())
    assert got.skipped == [(str(inner), "nested git repository (submodule)")] and {f[1] for f in got.files} == EXPECTED


def test_single_file_and_lists(repo):
    assert [f[1] for f in list_tree(str(repo / "a.py"), ScanOptions()).files] == ["a.py"]
    assert not list_tree(str(repo / "out" / "o.py"), ScanOptions(includes=("*.cs",))).files
    got = list_paths([str(repo / "a.py"), str(repo / "no"), str(repo / "a.py"), str(repo / "out/o.py")], ScanOptions())
    assert [os.path.basename(f[0]) for f in got.files] == ["a.py", "o.py"] and [r for _, r in got.skipped] == ["not found"]
    assert read_list("﻿a\n\n b\n") == ["a", " b"]


def test_snapshot_equals_disk(repo):
    entries = [os.path.relpath(os.path.join(d, f), repo) for d, _, fs in os.walk(repo) for f in fs if ".git/" not in os.path.relpath(os.path.join(d, f), repo)]
    read = lambda p: (repo / p).read_text()
    for options in (ScanOptions(), ScanOptions(respect_gitignore=False), ScanOptions(respect_gitattributes=False), ScanOptions(includes=("**/*.cs",)), ScanOptions(include_unknown=True)):
        disk = {f[1] for f in list_tree(str(repo), options).files}
        assert {p for p, _ in list_snapshot(entries, options, read)} == disk
    assert {p for p, _ in list_snapshot(entries, ScanOptions(), read, "src")} == {"src/b.cs"}


def test_git_source(spark, repo):
    register(spark)
    (repo / "a.py").write_text("changed\n")
    rows = spark.read.format("gittree").option("ref", "HEAD").load(str(repo)).where("skip_reason IS NULL")
    assert {r["rel_path"] for r in rows.select("rel_path").collect()} >= EXPECTED | {"gen/g.cs", "out/o.py"}
    assert bytes(rows.where("rel_path = 'a.py'").first()["content"]) == b"# a\nx = 1\n\n"
    below = spark.read.format("gittree").option("ref", "HEAD").load(str(repo / "src")).where("skip_reason IS NULL")
    assert {r["rel_path"] for r in below.collect()} == {"b.cs", "bin/no.cs"}
    filtered = spark.read.format("gittree").options(ref="HEAD", filters="true").load(str(repo)).where("skip_reason IS NULL")
    assert {r["rel_path"] for r in filtered.collect()} == EXPECTED


def test_runs(spark, repo, tmp_path):
    out = tmp_path / "r.json"
    assert job.run(spark, RunOptions(path=str(repo), output=str(out), by_file=True, detailed=True)) == OK
    saved = json.loads(out.read_text())
    assert saved["fileCount"] == 5 and {f["path"].split("/")[-1] for f in saved["files"]} == {"a.py", "b.cs", "_p.scss", ".editorconfig", ".d.py"}
    shown = []
    assert job.run(spark, RunOptions(path=str(repo), baseline=str(out), format="json"), show=shown.append) == OK
    change = json.loads(shown[0])
    assert change["total"] == {"code": 0, "comment": 0, "blank": 0, "total": 0} and all(x["total"] == 0 for x in change["byLanguage"])
    assert job.run(spark, RunOptions(path=str(repo), compare_to="HEAD", format="json"), show=shown.append) == OK
    assert json.loads(shown[1])["total"]["total"] == 0
    (repo / "copy.py").write_text((repo / "a.py").read_text())
    assert job.run(spark, RunOptions(path=str(repo), unique=True, format="csv"), show=shown.append) == OK
    assert "duplicate of " in shown[2] and shown[2].endswith("\r\n")
    quiet = lambda *_: None
    assert job.run(spark, RunOptions(path=str(repo), min_comment_pct=99.0), show=quiet, warn=quiet) == THRESHOLD
    assert job.run(spark, RunOptions(path=str(repo), sort="nope"), show=quiet, warn=quiet) == ERROR
    assert job.run(spark, RunOptions(path=str(repo), compare_to="HEAD", output="x.md"), show=quiet, warn=quiet) == ERROR
    for kind in ("markdown", "html", "table"):
        assert job.run(spark, RunOptions(path=str(repo), format=kind, detailed=True), show=shown.append, warn=quiet) == OK
    assert "## By File" in shown[3] and "<h2>Folders</h2>" in shown[4]


def test_options():
    assert output_format(None, "a.MD") == "markdown" and output_format(None, None) == "table" and output_format("JSON", "a.csv") == "json"
    for bad in (
        {"format": "x"}, {"min_comment_pct": 101}, {"top": 0}, {"sort": "x"}, {"scan": ScanOptions(include_langs=("nope",))}, {"git_hash": "a", "list_file": "b"}, {"watch": True, "format": "json"},
        {"watch": True, "baseline": "b"}, {"compare_to": "a", "baseline": "b"}, {"compare_to": "a", "watch": True},
    ):
        with pytest.raises(OptionError):
            RunOptions(**bad).check()
    RunOptions(scan=ScanOptions(include_langs=("other", "c#"))).check()


@pytest.mark.parametrize("code,comment,able,level", [(100, 0, True, "None"), (100, 2, True, "Low"), (95, 5, True, "Fair"), (90, 10, True, "Good"), (75, 25, True, "High"), (60, 40, True, "Dense"), (10, 90, True, "Dense"), (1, 1, False, "NotApplicable"), (0, 0, True, "NotApplicable")])
def test_health(spark, code, comment, able, level):
    assert spark.range(1).select(analysis.health(F.lit(code), F.lit(comment), F.lit(able))).first()[0] == level


def test_copies(spark):
    df = spark.createDataFrame([("a", "H", 2), ("b", "H", 1), ("c", None, 3), ("d", None, 4), ("e", "I", 5)], "path string, hash string, scan_ordinal long")
    kept, skipped = analysis.drop_copies(df)
    assert {r["path"] for r in kept.collect()} == {"b", "c", "d", "e"} and [(r["path"], r["reason"]) for r in skipped.collect()] == [("a", "duplicate of b")]


def test_empty_inputs(spark):
    files = spark.createDataFrame([], "scan_ordinal long, rel_path string, language string, text string")
    counted = analysis.analyze_text(files)
    assert analysis.by_language(counted).count() == 0 and analysis.grand_totals(counted).first()["files"] == 0
    assert analysis.below_threshold(analysis.grand_totals(counted), 5) is None


def test_baseline_shapes(spark, tmp_path):
    def load(body):
        path = tmp_path / "b.json"
        path.write_text(json.dumps(body))
        return diff.load_report(spark, str(path))

    row = lambda n, t: {"language": n, "files": 1, "code": t, "comment": 0, "blank": 0, "total": t}
    with pytest.raises(ValueError):
        load({"fileCount": 1})
    got, rest = diff.baseline_languages(load({"byLanguage": [], "skipped": []}))
    assert got.count() == 0 and rest.count() == 0
    got, rest = diff.baseline_languages(load({"total": 9, "code": 9, "byLanguage": [row("C", 5)], "byLanguageTruncated": True}))
    assert rest.first()["total"] == 4
    files = [{"path": "x", **row("c", 1)}, {"path": "y", **row("C", 2)}]
    got, rest = diff.baseline_languages(load({"total": 3, "byLanguage": [row("C", 2)], "byLanguageTruncated": True, "files": files}))
    assert [(r["language"], r["total"]) for r in got.collect()] == [("c", 3)] and rest.count() == 0
    cur = spark.createDataFrame([(0, "c", 7, 0, 0, 7)], "ordinal long, language string, code long, comment long, blank long, total long")
    base, _ = diff.baseline_languages(load({"byLanguage": [row("C", 1), row("c", 2), row("D", 3)]}))
    assert [(r["language"], r["total"]) for r in diff.diff_languages(cur, base).orderBy("ordinal").collect()] == [("c", 5), ("D", -3)]


def test_report_texts():
    assert reports.csv_field("=a,b") == '"\'=a,b"' and reports.csv_field('a"b') == '"a""b"' and reports.csv_field("a") == "a"
    assert reports.escape_markdown("a|b_c\n") == "a\\|b\\_c "
    assert reports.share(1, 16) == 6.3 and reports.share(0, 0) == 0.0
    assert reports.signed(1234) == "+1,234" and reports.signed(-5) == "-5" and reports.signed(0) == "0"
    folders = [{"folder": f, "files": n} for f, n in (("", 3), ("a", 3), ("a/b", 3), ("a/b/c", 1), ("a/b/d", 2))]
    assert [(d, x) for d, x, _ in reports.folder_tree(folders)] == [(0, "a/b"), (1, "c"), (1, "d")]


def test_retry_state():
    r = RetryState()
    assert not r.ready(0, False) and r.ready(0, True)
    assert [r.failed(0) for _ in range(6)] == [5, 10, 20, 40, 60, 60]
    assert not r.ready(59, True) and r.ready(60, False)
    r.succeeded()
    assert r.ready(0, True) and not r.ready(0, False)


def test_delta_stream(spark, tmp_path):
    from tallyspark.streaming.watch import count_deltas, summed

    schema = "path string, language string, code long, comment long, blank long, version long"
    rows = [("a", "C", 5, 1, 0, 1), ("b", "C", 2, 0, 0, 1)], [("a", "C", 3, 2, 1, 2)]
    (tmp_path / "in").mkdir()
    stream = count_deltas(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = summed(spark.read.parquet(str(tmp_path / "out"))).first()
    assert tuple(got) == ("C", 2, 5, 2, 1)


def test_run_of_a_file_list(spark, tmp_path):
    from tallyspark.plans import job

    for name, text in (("a.py", "# a\nx = 1\n"), ("b\u2028c.py", "y = 2\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "list").write_text("\r\n".join(str(tmp_path / n) for n in ("a.py", "b\u2028c.py", "a.py")), encoding="utf-8")
    files = job.load_files(spark, job.with_defaults(path=str(tmp_path), list_file=str(tmp_path / "list")))
    assert sorted(os.path.basename(r["path"]) for r in files.select("path").collect()) == ["a.py", "b\u2028c.py"]


def test_run_watches(spark, tmp_path):
    """A pass for each change, the code of the last one, errors told."""
    import time

    from tallyspark.plans import job

    (tmp_path / "a.py").write_text("x = 1\n")
    shown, told = [], []

    def stopped() -> bool:
        if len(shown) == 1 and not (tmp_path / "b.py").exists():
            (tmp_path / "b.py").write_text("y = 1\ny = 2\n")
        return len(shown) >= 2 or time.time() > end

    end = time.time() + 90
    code = job.run(spark, job.with_defaults(path=str(tmp_path), watch=True), show=shown.append, warn=told.append, stopped=stopped)
    assert code == 0 and len(shown) == 2 and shown[0] != shown[1] and not told


def test_version_sees_older_times(tmp_path):
    """An edit that keeps the size and sets a time below the newest is a change."""
    from tallyspark.streaming.watch import _Changes

    for n in "ab":
        (tmp_path / n).write_text("x")
        os.utime(tmp_path / n, (2000, 2000))
    before = _Changes({"path": str(tmp_path)}).version()
    os.utime(tmp_path / "a", (1000, 1000))
    assert _Changes({"path": str(tmp_path)}).version() != before


def test_folder_attributes_match_files_of_that_name():
    from tallyspark.sources.gitattributes import AttributeRules

    rules = AttributeRules().add("", ["vendor/ linguist-vendored"])
    assert rules.marked("vendor") and rules.marked("vendor/x.c") and not rules.marked("vendors/x.c")
