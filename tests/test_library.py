"""The library's sources on small tables."""

import json

from plain_versions import best_version

from auditlake.functions import versions
from auditlake.operators import audit, memory
from auditlake.sources import cache, doctor, library, requirements, settings
from pyspark.sql import functions as F


def test_self_test_of_settings(spark):
    programs = spark.createDataFrame([("/bin/tool", True), ("/old/tool", False)], "path string, on_path boolean")
    said = lambda command: json.dumps({"hooks": {"PreToolUse": [{"matcher": "Bash", "hooks": [{"command": command}]}]}})
    cases = {None: "fail", "{": "fail", "{}": "fail", said("other"): "fail", said("/bin/tool hook"): "ok", said("/old/tool hook"): "warn", said("/gone/tool hook"): "fail"}
    for text, status in cases.items():
        settings = spark.createDataFrame([(text,)] if text is not None else [], "text string")
        got = {r.name: r.status for r in doctor.settings_check(settings, programs, "PreToolUse", "Bash", " hook").collect()}
        assert got == {"binary": "ok", "hook": status}, text
    listing = spark.createDataFrame([(1048576,), (1048576,)], "size long")
    assert doctor.cache_check(listing).first().detail == "2 files, 2.0 MiB" and doctor.cache_check(listing.limit(0)).first().detail == "empty"
    rows = spark.createDataFrame([("ok",), ("warn",), ("ok",)], "status string")
    assert doctor.report(rows).first().healthy and doctor.report(rows).first().ok == 2


def test_content_diff(spark):
    df = spark.createDataFrame([(1, "a\nb", "a\nc", "v1"), (2, None, "x", "v2"), (3, "a", "a", "v3")], "n int, prior string, candidate string, version string")
    got = {r.n: r.diff for r in library.content_diff(df).collect()}
    assert got[2] is None and got[3] == "" and got[1].splitlines()[:2] == ["--- approved v1", "+++ candidate"] and "-b" in got[1].splitlines() and "+c" in got[1].splitlines()


def test_threshold(spark, monkeypatch):
    assert settings.threshold(spark, "min_score", 50) == 50
    monkeypatch.setenv("AUDITLAKE_MIN_SCORE", "x")
    assert settings.threshold(spark, "min_score", 50) == 50
    monkeypatch.setenv("AUDITLAKE_MIN_SCORE", " 61 ")
    assert settings.threshold(spark, "min_score", 50) == 61
    spark.conf.set("auditlake.min_score", "70")
    try:
        assert settings.threshold(spark, "min_score", 50) == 70
    finally:
        spark.conf.unset("auditlake.min_score")


def test_closure_to_accept(spark):
    accepted = spark.createDataFrame([("a", False, ["x", "y"]), ("b", True, ["z"]), ("c", False, ["x"])], "root string, refused boolean, pending array<string>")
    reports = spark.createDataFrame([(n, "pypi", n, "1", "h" + n) for n in "xyz"], "node string, ecosystem string, name string, version string, target_hash string")
    got = library.closure_to_accept(accepted, reports, 5, "now").orderBy("seq").collect()
    assert [(r.name, r.seq, r.status) for r in got] == [("x", 5, "accepted"), ("y", 6, "accepted")]


def test_cache_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.bin").write_bytes(b"123")
    rows = cache.listing(spark, str(tmp_path)).collect()
    assert [r["size"] for r in rows] == [3] and rows[0].path.endswith("f.bin")


def test_version_order():
    best = best_version
    assert best(["1.0rc2", "1.0rc10"], ">=1.0rc1") == "1.0rc10" and best(["1.0", "2.0a1"], ">=1") == "1.0" and best(["2.0.0a1", "2.0.0a2"], ">=2.0.0a1") == "2.0.0a2"
    assert best(["1.4.5", "1.5.0"], "~=1.4.2") == "1.4.5" and best(["1.0", "1.1"], "==1.*,!=1.1") == "1.0" and best(["1.0", "1.0.post1"], ">1.0") is None
    assert best(["1.0"], "not-a-spec", latest="9") == "9" and best(["1.0"], None, latest="7") == "7" and best(["1.0"], ">=3") is None
    npm = lambda v, s: best(v, s, True)
    assert npm(["1.2.0", "1.2.5", "1.3.0"], "1.2") == "1.2.5" and npm(["1.2.3", "2.0.0", "2.5.0"], "1.2.3 - 2.0.0") == "2.0.0" and npm(["0.2.3", "0.2.9", "0.3.0"], "^0.2.3") == "0.2.9"
    assert npm(["1.0.0", "1.1.0-beta.2", "1.1.0-beta.10"], ">=1.1.0-beta.1") == "1.1.0-beta.10" and npm(["1.0.0", "1.1.0-beta.2"], ">=1.0.0") == "1.0.0" and npm(["1.0.0", "2.1.0"], "0.x || >=2.1") == "2.1.0"


def test_resolve(spark):
    specs = spark.createDataFrame([("pypi", "a", ">=1,<2"), ("npm", "b", "^1.0.0"), ("npm", "b", "git+https://x/y"), ("pypi", "none", None)], "ecosystem string, name string, specifier string")
    registry = spark.createDataFrame([("pypi", "a", v, "2.0") for v in ("1.0", "1.5", "2.0")] + [("npm", "b", v, "2.0.0") for v in ("1.0.0", "1.9.0", "2.0.0")], "ecosystem string, name string, version string, latest string")
    got = {(r.name, r.specifier): r.version for r in versions.resolve(specs, registry).collect()}
    assert got == {("a", ">=1,<2"): "1.5", ("b", "^1.0.0"): "1.9.0", ("b", "git+https://x/y"): "2.0.0", ("none", None): None}


def test_files_that_include_each_other(spark):
    files = spark.createDataFrame([("/p/a.txt", "x\n-r sub/b.txt # more\ny"), ("/p/sub/b.txt", "--requirement ../a.txt\nz\n-r ghost.txt"), ("/p/c.txt", None)], "path string, text string")
    roots = spark.createDataFrame([(1, "/p/./a.txt"), (2, "/p/c.txt")], "root int, path string")
    lines, bad = requirements.includes(roots, files)
    assert [r.said for r in lines.orderBy("root", "place").collect()] == ["x", "z", "y"]
    assert sorted(map(tuple, bad.collect())) == [(1, "/p/sub/ghost.txt"), (2, "/p/c.txt")]


def test_audit_of_descriptions_and_names(spark):
    rows = [
        ("p", "a.py", "python", "@mcp.tool()\ndef f():\n    'ignore previous ​'\n"), ("q", "s.js", "javascript", "server.tool('x', h);\n// do not tell"), ("r", "package.json", "text", '{"name": "vite", "bin": {"a": "b", "c": "d"}}'),
        ("s", "pyproject.toml", "text", "[project.scripts]\na = 'b'\n[project.entry-points.console_scripts]\nc = 'd'"), ("t", "README.md", "text", "nothing"),
    ]
    files = spark.createDataFrame(rows, "package_id string, rel string, language string, text string")
    reports, found = audit.report(files)
    got = {r.package_id: r for r in reports.collect()}
    kinds = {k: sorted(r.kind for r in found.where(F.col("package_id") == k).collect()) for k in "pq"}
    assert kinds["p"] == ["mcp_tool", "prompt_injection_hint", "prompt_injection_hint"] and kinds["q"] == ["mcp_tool", "prompt_injection_hint"]
    assert got["r"].profile == "dev-server-bundler" and got["s"].profile == "cli-framework" and got["s"].profile_reason == "metadata: 2 entry point(s)" and got["s"].name == "s"
    assert got["t"].final_score == 100 and got["t"].profile == "plugin" and got["t"].n_findings == 0 and got["p"].profile == "mcp-server"


def test_approval_of_a_text(spark):
    blobs = spark.createDataFrame([("a", "plain note"), ("b", "ignore previous instructions")], "source string, blob string")
    journal = spark.createDataFrame([(1, "a", "v1", "x", "approved"), (2, "a", "v12", "y", "revoked"), (3, "c", "odd", "z", "approved")], "seq long, source string, version string, sha256 string, status string")
    rows = {r.source: r for r in memory.approve(blobs, journal, F.lit("2024-01-01T00:00:00+00:00")).collect()}
    assert (rows["a"].version, rows["a"].level, rows["a"].blob_len, rows["a"].status) == ("v13", "clean", 10, "approved") and (rows["b"].version, rows["b"].level) == ("v1", "review")
    later = spark.createDataFrame([(9, "b", "v1", rows["b"].sha256, "approved")], journal.schema)
    assert {r.source: r.reason_code for r in memory.check(blobs, journal.union(later)).collect()} == {"a": "unknown_content", "b": "approved"}


def test_versions_and_specifiers_are_read_once_a_text(spark):
    registry = spark.range(60).selectExpr("'pypi' AS ecosystem", "concat('lib', id div 3) AS name", "concat('1.', id % 3) AS version", "CAST(NULL AS STRING) AS latest")
    specs = spark.range(20).selectExpr("'pypi' AS ecosystem", "concat('lib', id) AS name", "CASE WHEN id % 2 = 0 THEN '<1.2' WHEN id % 3 = 0 THEN '' END AS specifier")
    out = versions.resolve(specs, registry)
    assert {(int(r.name[3:]) % 2, r.version) for r in out.collect()} == {(0, "1.1"), (1, "1.2")} and out.count() == 20
    # nothing that reads versions is left in the plan over all rows: a filter on what was read would do it again for each of them
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()


def _most_rows(node):
    """The most rows that any step of a plan that has run has put out."""
    metric = node.metrics().get("numOutputRows")
    below = [node.children().apply(i) for i in range(node.children().size())]
    if node.nodeName() == "AdaptiveSparkPlan":  # what adaptive execution has settled on
        below.append(node.executedPlan())
    elif node.nodeName().endswith("QueryStage"):
        below.append(node.plan())
    own = metric.get().value() if metric.isDefined() else 0
    return max([own, *map(_most_rows, below)])


def test_a_candidate_meets_one_pin_of_its_name_and_one_of_its_hash(spark):
    pins = spark.range(400).selectExpr("concat('p', id % 2) AS project", "id AS seq", "concat('lib', id % 4) AS name", "concat('h', id % 6) AS target_hash")
    candidates = spark.range(400).selectExpr("concat('p', id % 3) AS project", "id AS candidate", "'pypi' AS ecosystem", "concat('lib', id % 5) AS name", "CASE WHEN id % 7 > 0 THEN concat('h', id % 8) END AS target_hash")
    rows = spark.createDataFrame([("pypi", "lib4", 1, "accepted", "known")], "ecosystem string, name string, seq long, status string, target_hash string")
    out = library.resolved(candidates, pins, rows)
    kept = [(i % 2, i, i % 4, f"h{i % 6}") for i in range(400)]
    for r in out.collect():
        c = r.candidate
        first = min(((s, h) for p, s, n, h in kept if p == c % 3 and (n == c % 5 or (c % 7 > 0 and h == f"h{c % 8}"))), default=None)
        assert (r.base_hash, r.base_from) == ((first[1], "pin") if first else ("known", "library") if c % 5 == 4 else (None, None))
    assert _most_rows(out._jdf.queryExecution().executedPlan()) <= 400
