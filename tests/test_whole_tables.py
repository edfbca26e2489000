"""Queries against brute force over small tables: every row counts, whatever its id or length."""

import hashlib

from auditlake.plans import registry


def saved(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_content_hash_covers_long_and_null_texts(spark, tmp_path):
    rows = [(i, "ä" * (i * 700), f"s{i % 3}") for i in range(12)] + [(20, None, "s0"), (3, "again", "s0"), (21, "of no source", None), (22, None, None), (None, "of no id", "s1")]
    sf = saved(spark, tmp_path, documents=(rows, "doc_id long, text string, source string"))
    expected = {}
    for source in {s for _, _, s in rows}:
        files = sorted((f"doc{i}.txt" if i is not None else "", t or "") for i, t, s in rows if s == source)
        expected[source] = hashlib.sha256("".join(f"{r}\0{t}\0" for r, t in files).encode()).hexdigest()
    got = [(r.package_id, r.target_hash) for r in registry.queries()["content_hash_by_source"](spark, sf).collect()]
    assert dict(got) == expected and len(got) == len(expected)


def walked(children, status, root, most=5):
    """The pre-order of a root's tree: (node, depth, cycle, truncated, names on the way below the root)."""
    seen, out = set(), []

    def visit(node, depth, way):
        cycle = node in seen
        seen.add(node)
        out.append((node, depth, cycle, not cycle and depth >= most, way))
        if not cycle and depth < most:
            for c in children[node]:
                visit(c, depth + 1, [*way, c])

    visit(root, 0, [])
    return out


def test_every_package_is_a_root(spark, tmp_path):
    ids = range(1, 61)
    sf = saved(spark, tmp_path, supplier=([(i,) for i in ids], "s_suppkey long"))
    every = {k: [2 * k, 2 * k + 1, *([k + 3] if k % 5 == 0 else []), *([k // 4] if k % 7 == 0 else [])] for k in ids}
    children = {k: [c for c in v if c in ids] for k, v in every.items()}
    status = {k: "drift" if k % 23 == 0 else "first-encounter-accepted" if k % 3 == 0 else "safe" for k in ids}
    closure, tree, composed, accept = set(), [], {}, {}
    for root in ids:
        depth, front = {root: 0}, [root]
        for d in range(1, 6):
            front = sorted({c for n in front for c in children[n]} - set(depth))
            depth |= dict.fromkeys(front, d)
        closure |= {(root, n, d) for n, d in depth.items()}
        rows = walked(children, status, root)
        tree += [(f"p{root}", f"p{n}", d, cycle, cut) for n, d, cycle, cut, _ in rows]
        bad = next((way for n, _, cycle, cut, way in rows if status[n] == "drift" and not cycle and not cut), None)
        composed[f"p{root}"] = "safe" if bad is None else "".join(f"blocked-via:p{n}=" for n in bad) + "drift"
        accept[f"p{root}"] = (any(status[n] == "drift" for n, _, cycle, _, _ in rows if not cycle), 0)
    run = lambda name: registry.queries()[name](spark, sf)
    assert sorted((r.root, r.node, r.depth) for r in run("dependency_closure").collect()) == sorted(closure)
    assert [(r.root, r.node, r.depth, r.cycle, r.truncated) for r in sorted(run("closure_tree").collect(), key=lambda r: (int(r.root[1:]), r.path))] == tree
    assert {r.root: r.composed_status for r in run("closure_status").collect()} == composed
    assert {r.root: (r.refused, r.n_pending) for r in run("closure_accept").collect()} == accept


def test_memory_reports_read_the_whole_journal(spark, tmp_path):
    rows = [(i, f"text {i}", f"s{i % 4}") for i in range(1, 40)] + [(66, "last", "s9"), (51, "last of s8", "s8")]
    sf = saved(spark, tmp_path, documents=(rows, "doc_id long, text string, source string"))
    of = lambda s: [i for i, _, x in rows if x == s]
    sources = {s for _, _, s in rows}
    got = {r.source: r.next_version for r in registry.queries()["memory_next_version"](spark, sf).collect()}
    assert got == {s: f"v{max(i % 17 + 1 for i in of(s)) + 1}" for s in sources}
    got = {r.source: (r.seq, r.version, r.sha256) for r in registry.queries()["memory_latest_approved"](spark, sf).collect()}
    last = {s: max(i for i in of(s) if i % 5) for s in sources}
    said = {i: t for i, t, _ in rows}
    assert got == {s: (i, f"v{i % 17 + 1}", hashlib.sha256(said[i].encode()).hexdigest()) for s, i in last.items()}


def test_policy_and_baselines_cover_every_event(spark, tmp_path):
    from datetime import datetime

    from auditlake.functions import constants as C

    kinds = ["click", "view", "purchase", "signup"]
    rows = [(i, datetime(2024, 1, 1), i % 7 if i < 200 else 100 + i, kinds[i % 4], float(i % 120)) for i in range(240)]
    sf = saved(spark, tmp_path, events=(rows, "event_id long, ts timestamp, user_id long, event_type string, value double"))
    hints = {}
    for i, _, user, _, _ in rows:
        kind = C.KINDS[i % 15]
        h = hints.setdefault(f"pkg{user}", [False, False, False])
        h[0] |= kind == "outbound_network" and i % 7 != 0
        h[1] |= kind == "outbound_dynamic"
        h[2] |= kind == "listening_port"
    got = {r.package_id: (r.fully_offline_capable, r.allowlist_sufficient, r.needs_proxy_or_block) for r in registry.queries()["policy_hints"](spark, sf).collect()}
    assert got == {p: (not (h or d or port), h and not d, d) for p, (h, d, port) in hints.items()}

    eco = lambda user: "pypi" if user % 2 == 0 else "npm"
    puts = [(i, user, i % 5, i % 977, kind) for i, _, user, kind, _ in rows if i % 50 != 7]
    gone = {}
    for i, _, user, _, _ in rows:
        if i % 50 == 7:
            gone[user, i % 5] = max(i, gone.get((user, i % 5), -1))
    latest = {}
    for i, user, version, digest, kind in puts:
        if i > gone.get((user, version), -1):
            latest[user, digest] = (i, version, kind)
    good = [(user, version, i) for (user, _), (i, version, kind) in latest.items() if kind in ("click", "signup")]
    expected = {}
    for i, user, version, _, _ in puts:
        same = [j for u, v, j in good if u == user and v == version]
        expected[i] = (eco(user), f"lib{user}", max(same or [j for u, _, j in good if u == user], default=None))
    got = registry.queries()["baseline_choice"](spark, sf).collect()
    assert len(got) == len(puts) and {r.candidate: (r.ecosystem, r.name, r.baseline_seq) for r in got} == expected


def test_entropy_and_includes_read_every_row(spark, tmp_path):
    import math
    from collections import Counter
    from decimal import ROUND_HALF_UP, Decimal

    sf = saved(spark, tmp_path, pages=([(i,) for i in range(20)], "page_id long"), supplier=([(i,) for i in range(1, 10)], "s_suppkey long"))
    expected = set()
    for i in range(0, 20, 2):  # the others have blobs of two letters, whose entropy is too low
        h = "".join(hashlib.md5(f"{i}{c}".encode()).hexdigest() for c in "abcd")
        blob = h + h[:64].upper() + "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"
        bits = round(-sum(n / len(blob) * math.log2(n / len(blob)) for n in Counter(blob).values()), 2)
        expected.add((i, len(blob), float(Decimal(str(bits)).quantize(Decimal("0.1"), ROUND_HALF_UP))))
    got = [(r.page_id, r.length, r.entropy) for r in registry.queries()["base64_entropy"](spark, sf).collect()]
    assert set(got) == expected and len(got) == 10
    got = [(r.package_id, r.name, r.specifier) for r in registry.queries()["requirement_includes"](spark, sf).collect()]
    assert sorted(got) == sorted((i, *r) for i in range(1, 10) for r in (("flask", ">=2"), ("requests", ">=1.0")))
