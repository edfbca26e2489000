import random

import pytest
from plain_versions import best_version, npm_key, pypi_key
from pyspark.sql import functions as F

from auditlake.functions import versions
from auditlake.operators import closure


def walk(children, status, root, max_depth, leaves=()):
    """(path, node, parent, depth, cycle, truncated, status) in pre-order."""
    seen, out = set(), []

    def visit(node, parent, depth, path):
        if node in seen and node not in leaves:
            out.append((path, node, parent, depth, True, False, None))
            return
        seen.add(node)
        cut = depth >= max_depth
        out.append((path, node, parent, depth, False, cut, status.get(node)))
        if not cut:
            for i, c in children.get(node, []):
                visit(c, node, depth + 1, f"{path}.{i:06d}")

    visit(root, None, 0, "000000")
    return out


@pytest.mark.parametrize("max_depth", [5, 2])
def test_first_visits_of_random_graphs(spark, max_depth):
    """200 graphs at once, with cycles, diamonds, self-loops, repeated children and nodes that stand for nothing."""
    r = random.Random(max_depth)
    edges, roots, status, leaves, expected = [], [], [], set(), {}
    for g in range(200):
        nodes = [f"g{g}n{i}" for i in range(r.randrange(1, 10))]
        children = {}
        for n in nodes[: len(nodes) - g % 2]:
            own = [(i, r.choice(nodes)) for i in range(r.choice([0, 1, 2, 2, 3, 5]))]
            if g % 2:
                own = [(i, c) for i, c in own if c != nodes[-1]] + [(7, nodes[-1])]
            children[n] = own
            edges += [(n, i, c) for i, c in own]
        if g % 2:
            leaves.add(nodes[-1])
        own = {n: r.choice(["safe", "safe", "drift", "first-encounter-accepted"]) for n in nodes}
        status += [(n, s, n in leaves) for n, s in own.items()]
        for root in r.sample(nodes, min(2, len(nodes))):
            roots.append((root,))
            expected[root] = walk(children, own, root, max_depth, leaves)
    tree = closure.tree(spark.createDataFrame(roots, "node string"), spark.createDataFrame(edges, "parent string, ordinal int, child string"), spark.createDataFrame(status, "node string, status string, leaf boolean"), max_depth)
    got = {}
    for x in tree.collect():
        got.setdefault(x.root, []).append((x.path, x.node, x.parent, x.depth, x.cycle, x.truncated, x.status))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def python_version(r):
    v = ".".join(str(r.choice([0, 0, 1, 2, 10, 3])) for _ in range(r.choice([1, 2, 2, 3, 3, 4])))
    v = "1!" + v if r.random() < 0.1 else v
    v += r.choice(["a", "b", "rc", ".alpha", "-beta", "c", "preview"]) + r.choice(["", "1", "2", "10"]) if r.random() < 0.3 else ""
    v += r.choice([".post", ".post1", "-3", "rev2", ".r10"]) if r.random() < 0.2 else ""
    v += r.choice([".dev", ".dev1", ".dev12"]) if r.random() < 0.2 else ""
    return v + ("+" + r.choice(["a", "1", "a.1", "10.b", "ubuntu-2"]) if r.random() < 0.15 else "")


def python_specifier(r):
    def clause():
        op = r.choice(["==", "!=", "~=", "<=", ">=", "<", ">", "==="])
        if op in ("==", "!=") and r.random() < 0.5:
            return f"{op}{r.randrange(4)}{r.choice(['', '.0', '.1', '.0.0'])}.*"
        if op == "~=":
            return f"~={r.choice(['', '1!'])}{r.randrange(3)}.{r.randrange(4)}{r.choice(['', '.0', 'rc1', '.2.post1'])}"
        return op + r.choice(["", " "]) + python_version(r)

    return r.choice([",", " , "]).join(clause() for _ in range(r.choice([1, 1, 2, 3]))) if r.random() > 0.05 else r.choice(["", "*", "latest", "junk", "~=1", ">=1.*", "==x"])


def node_version(r):
    v = ".".join(str(r.choice([0, 0, 1, 2, 10])) for _ in range(3))
    v += "-" + r.choice(["a", "alpha.1", "1", "rc.2", "beta.10", "x-y.3"]) if r.random() < 0.3 else ""
    return v + ("+b1" if r.random() < 0.1 else "")


def node_specifier(r):
    def part():
        v, x = node_version(r), r.random()
        return v if x > 0.4 else ".".join(v.split("-")[0].split("+")[0].split(".")[: r.choice([1, 2])]) + (".x" if x < 0.1 else "")

    def one():
        return part() + " - " + part() if r.random() < 0.1 else " ".join(r.choice(["", "^", "~", ">=", "<=", "<", ">", "=", "~>"]) + part() for _ in range(r.choice([1, 1, 2])))

    return " || ".join(one() for _ in range(r.choice([1, 1, 2]))) if r.random() > 0.06 else r.choice(["", "*", "latest", "junk!", "git+x", "a/b", "x", "^", "v1.2.3", "1.x || >=2"])


def test_versions_resolve_as_by_plain_rules(spark):
    r = random.Random(12)
    registry, specs, known, tags = [], [], {}, {}
    for k in range(30):
        for eco, version in (("pypi", python_version), ("npm", node_version)):
            own = sorted({version(r) for _ in range(22)} | {"no version"})
            tags[eco, f"p{k}"] = "9.9.9" if k % 2 else None
            known[eco, f"p{k}"] = own
            registry += [(eco, f"p{k}", v, tags[eco, f"p{k}"]) for v in own]
            specs += [(eco, f"p{k}", (python_specifier if eco == "pypi" else node_specifier)(r)) for _ in range(40)]
        specs.append(("npm", f"p{k}", None))
    specs += [("pypi", "ghost", ">=1"), specs[0]]
    of = lambda rows, c: spark.createDataFrame(rows, f"ecosystem string, name string, {c}")
    got = versions.resolve(of(specs, "specifier string"), of(registry, "version string, latest string")).collect()
    assert len(got) == len(specs)
    some = 0
    for x in got:
        want = best_version(known.get((x.ecosystem, x.name), []), x.specifier, x.ecosystem == "npm", tags.get((x.ecosystem, x.name)))
        order = npm_key if x.ecosystem == "npm" else pypi_key
        assert x.version == want or order(x.version) == order(want), x
        some += want is not None
    assert some > 800 and versions.resolve(of([], "specifier string"), of([], "version string, latest string")).collect() == []


def test_version_keys_sort_as_versions(spark):
    r = random.Random(3)
    for eco, make, key in (("pypi", python_version, pypi_key), ("npm", node_version, npm_key)):
        all_ = sorted({make(r) for _ in range(400)})
        rows = spark.createDataFrame([(v,) for v in all_], "v string").select("v", versions.order(F.col("v"), F.lit(eco))["key"].alias("k")).collect()
        of = {x.v: x.k for x in rows}
        ranked = sorted(all_, key=key)
        assert all((of[a] < of[b]) == (key(a) < key(b)) and (of[a] == of[b]) == (key(a) == key(b)) for a, b in zip(ranked, ranked[1:]))


def test_tree_audit_equals_a_plain_recursion(spark, tmp_path):
    """Resolve, audit, verdict and children of every version, walked by hand over the same tables."""
    from plain_versions import best_version as best

    from auditlake.operators import preflight
    from auditlake.plans import trees

    spark.createDataFrame([(i,) for i in range(1, 31)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    inputs = trees.tree_inputs(spark, str(tmp_path))
    roots, packages, files, registry, rows, kept = inputs
    tree, judged = preflight.audit_tree(*inputs)
    status = {(r.name, r.version): r.status for r in judged.collect()}
    assert len(set(status.values())) > 2
    # every version that has files is judged as it is on its own
    alone, _ = preflight.preflight(packages, files, rows, kept, pinned=False)
    alone = {(r.name, r.version): r.status for r in alone.collect()}
    assert status.items() <= alone.items()
    known, latest, metas = {}, {}, {}
    for r in registry.collect():
        known.setdefault(r.name, []).append(r.version)
        latest[r.name] = r.latest
    package = {r.package_id: (r.name, r.version) for r in packages.collect()}
    for r in files.where("rel LIKE '%METADATA'").collect():
        asks = [x.split(":", 1)[1].strip().lower() for x in r.text.split("\n") if x.startswith("Requires-Dist:")]
        own = {}
        for a in asks:
            n = next(i for i in range(len(a) + 1) if i == len(a) or not a[i].isalnum())
            own.setdefault(a[:n], a[n:].strip().strip("()"))
        metas[package[r.package_id]] = list(own.items())

    def visit(name, specifier, depth, seen, out, path):
        version = best(known.get(name, []), specifier or None, False, latest.get(name))
        if version is None:
            out.append((path, f"pypi:{name}==?", depth, False, False, "error"))
            return "error"
        node = (name, version)
        label = f"pypi:{name}=={version}"
        if node in seen:
            out.append((path, label, depth, True, False, None))
            return "safe"
        seen.add(node)
        own = alone.get(node, "error")
        out.append((path, label, depth, False, depth >= 5 and own != "error", own))
        below = []
        if depth < 5:
            for i, (child, spec) in enumerate(metas.get(node, [])):
                below.append((child, visit(child, spec, depth + 1, seen, out, f"{path}.{i:06d}")))
        if depth >= 5 and own != "error":
            return "safe"
        if own not in ("safe", "first-encounter-accepted"):
            return own
        return next((f"blocked-via:{c}={s}" for c, s in below if s not in ("safe", "first-encounter-accepted")), "safe")

    got = {}
    for r in tree.collect():
        got.setdefault(r.root, []).append((r.path, r.node, r.depth, r.cycle, r.truncated, r.status))
    composed = {r.root: r.composed_status for r in closure.composed_status(tree).collect()}
    some = 0
    for r in roots.collect():
        out = []
        said = visit(r.name.lower(), r.specifier, 0, set(), out, "000000")
        root = out[0][1]
        # ordinals have gaps where requirements are left out, so the order counts
        plain = [x[1:] for x in out]
        assert [x[1:] for x in sorted(got[root])] == plain
        assert composed[root] == said
        some += len(out)
    assert some > 200


def test_verdicts_become_baselines(spark, tmp_path):
    """Preflight, written to a journal, read again: what was accepted is safe then, and a new surface is drift."""
    from auditlake.operators import preflight
    from auditlake.sources import journal

    specs = spark.createDataFrame([("p1", "pypi", "one", "1"), ("p2", "pypi", "two", "1")], "package_id string, ecosystem string, name string, version string")
    files = lambda extra: spark.createDataFrame([("p1", "m.py", "python", "x = 1\n" + extra), ("p2", "m.py", "python", "import os\nos.system('a')\nos.popen('b')\nexec(c)\n" * 9)], "package_id string, rel string, language string, text string")
    none = spark.createDataFrame([], "seq long, op string, ecosystem string, name string, version string, target_hash string, profile string, profile_reason string, score int, role_typical_share double, status string, audited_at string, schema_version int, baselined_at string, refreshed_at string")
    kept = spark.createDataFrame([], "kept_ecosystem string, kept_name string, kept_hash string, kind string, file string, line int, detail string, seq long, host string, fqn string")
    judged, found = preflight.preflight(specs, files(""), none, kept)
    assert {r.name: (r.status, r.write_status) for r in judged.collect()} == {"one": ("first-encounter-accepted", "accepted"), "two": ("low-score", "blocked-suspicious")}
    path = str(tmp_path / "journal")
    rows = preflight.to_journal(judged, 1, "2024-01-01T00:00:00+00:00")
    journal.append(rows.select(*[F.col(f.name).cast(f.dataType) for f in none.schema.fields]), path)
    rows = journal.index(spark.read.schema(none.schema).parquet(path))
    assert rows.count() == 2
    hashes = judged.select("package_id", F.col("ecosystem").alias("kept_ecosystem"), F.col("name").alias("kept_name"), F.col("target_hash").alias("kept_hash"))
    kept = found.join(hashes, "package_id").drop("package_id")
    again = {r.name: r.status for r in preflight.preflight(specs, files(""), rows, kept)[0].collect()}
    assert again == {"one": "safe", "two": "low-score"}
    changed = {r.name: (r.status, list(r.reasons)) for r in preflight.preflight(specs, files("import subprocess\nsubprocess.run(a)\n"), rows, kept)[0].collect()}
    assert changed["one"] == ("drift", ["novel high-risk surfaces vs. baseline: subprocess"])
    prior = [x for x in changed["two"][1] if x.startswith("prior blocked")]
    assert len(prior) == 1 and "1 (blocked-suspicious" in prior[0]
