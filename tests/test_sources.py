import io
import tarfile

from plain_versions import best_version

from auditlake.operators import closure, diff, verdict
from auditlake.sources import files, journal, requirements
from pyspark.sql import functions as F


def test_scan_decodes_and_prunes(spark, tmp_path):
    for rel, content in {"p/a.py": b"x\r\ny\r", "p/b.bin": b"\0", "p/.git/c.py": b"z", "p/dist/d.js": b"\xff", "q/README": b"hi"}.items():
        path = tmp_path / "root" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    got = {(r.package_id, r.rel): (r.language, r.text) for r in files.scan(spark, str(tmp_path / "root")).collect()}
    assert got == {("p", "a.py"): ("python", "x\ny\n"), ("p", "dist/d.js"): ("javascript", "�"), ("q", "README"): ("text", "hi")}


def test_unpack_and_metadata(spark):
    def archive(members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, body in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        return out.getvalue()

    good = archive({"pkg-1/pyproject.toml": b"[project]\nname = 'pkg'\nversion = '1'\nscripts = {a = 'b:c'}\ndependencies = ['x>=1', 'y; extra == \"d\"']", "../evil.py": b"x"})
    raw = files.unpack(spark.createDataFrame([("p", "a.tar.gz", good), ("q", "b.zip", b"broken")], "package_id string, path string, content binary"))
    found = files.audit_root(files.classify(raw).withColumn("ecosystem", F.lit("pypi")))
    assert [r.rel for r in found.collect()] == ["pyproject.toml"]
    meta = files.metadata(found).first()
    assert (meta.name, meta.version, meta.entry_points > 0) == ("pkg", "1", True)
    assert [(r.name, r.specifier) for r in requirements.declared(found).collect()] == [("x", ">=1")]


def test_versions():
    best = best_version
    assert best(["1.0", "1.2", "2.0", "2.1rc1"], ">=1,<2") == "1.2"
    assert best(["1.0", "2.0", "3.0a1"], None) == "2.0" and best(["1.0a1"], ">=0") == "1.0a1"
    assert best(["1.0.0", "1.4.2", "2.0.0"], "^1.0.0", True) == "1.4.2" and best(["1.0.0"], "git+https://x", True) == "1.0.0"
    assert best(["1.4.5", "1.5.0"], "~=1.4.2") == "1.4.5" and best([], ">=1") is None and best(["1.0", "1.1"], "==1.*") == "1.1"


def test_tree_marks_later_visits_and_blocks(spark):
    edges = spark.createDataFrame([("a", 0, "b"), ("b", 0, "a"), ("a", 1, "c"), ("c", 0, "b"), ("c", 1, "d")], "parent string, ordinal int, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    status = spark.createDataFrame([("a", "safe"), ("b", "safe"), ("c", "first-encounter-accepted"), ("d", "drift")], "node string, status string")
    tree = closure.tree(roots, edges, status)
    rows = [(r.node, r.depth, r.cycle) for r in tree.orderBy("path").collect()]
    assert rows == [("a", 0, False), ("b", 1, False), ("a", 2, True), ("c", 1, False), ("b", 2, True), ("d", 2, False)]
    assert closure.composed_status(tree).first().composed_status == "blocked-via:c=blocked-via:d=drift"
    assert closure.accept_closure(tree).first().refused
    cut = closure.tree(roots, edges, status, max_depth=1)
    assert closure.composed_status(cut).first().composed_status == "safe"
    assert [r.line for r in closure.render(cut).orderBy("path").collect()] == ["a [safe]", "  - b (truncated)", "  - c (truncated)"]


def test_signature_falls_back_to_the_place(spark):
    rows = spark.createDataFrame([("p", 1, "hardcoded_host", "f", 1, "d", ("x.io",)), ("p", 2, "hardcoded_host", "f", 2, "e", ("x.io",)), ("p", 3, "hardcoded_host", "f", 3, "d", (None,))], "package_id string, seq int, kind string, file string, line int, detail string, extra struct<host:string>")
    extra = F.struct("extra.host", *[F.lit(None).cast("string").alias(k) for k in ("fqn", "method", "env_name", "name", "reason", "owner")])
    got = diff.signatures(rows.withColumn("extra", extra)).collect()
    assert sorted((r.signature, r.seq) for r in got) == [("hardcoded_host:f:3:d", 3), ("hardcoded_host:x.io", 2)]


def test_baseline_prefers_the_same_version(spark):
    rows = spark.createDataFrame([("pypi", "a", "1", 1, None), ("pypi", "a", "2", 2, "accepted"), ("pypi", "a", "3", 3, "blocked-suspicious")], "ecosystem string, name string, version string, seq int, status string")
    specs = spark.createDataFrame([("pypi", "a", "1"), ("pypi", "a", "3"), ("npm", "a", "1")], "ecosystem string, name string, version string")
    got = {(r.ecosystem, r.version): r.baseline and r.baseline.seq for r in verdict.baseline_of(specs, rows).collect()}
    assert got == {("pypi", "1"): 1, ("pypi", "3"): 2, ("npm", "1"): None}


def test_pins_replace_by_name_or_hash(spark):
    rows = spark.createDataFrame([("p", 1, "a", "h1"), ("p", 2, "b", "h1"), ("p", 3, "b", "h3"), ("q", 4, "a", "h1")], "project string, seq int, name string, target_hash string")
    assert sorted(r.seq for r in journal.pins(rows).collect()) == [3, 4]
