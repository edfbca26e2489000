"""Queries from files and registries to verdicts: versions, manifests, names by prefix, preflight and dependency trees.

Packages are suppliers, registries are parts: each has a few versions whose numbers, manifests and code follow its key.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import versions
from ..operators import audit, closure, preflight, profiles, python_ast
from ..sources import files as S
from ..sources import journal, library, requirements
from ..sources.scratch import cut, folder
from ..streaming import verdicts
from . import derived as D
from .findings import _WEIGHTS

# --- a registry of twelve versions for each part, and one specifier ----------------------------------
_NUMBERS = {"major": "1 + i div 6", "minor": "i * (p_partkey % 3 + 1) % 5", "patch": "i % 3", "rc": "CASE WHEN i % 4 = 3 THEN 1 ELSE 0 END"}
_ECO = "CASE WHEN p_partkey % 2 = 0 THEN 'pypi' ELSE 'npm' END"
_A, _B = "CAST(1 + p_partkey div 2 % 2 AS STRING)", "CAST(p_partkey div 4 % 4 AS STRING)"
_FORM = "p_partkey div 2 % 12"
_PYPI = [">={a}.{b},<2", "~={a}.{b}", "=={a}.*", "!={a}.{b}.*, >={a}", "", "*", ">2", "<{a}.{b}.1rc1", "=={a}.{b}.0", "bad!", "<=1.3.2", "~={a}.{b}.1"]
_NPM = ["^{a}.{b}.0", "~{a}.{b}", "{a}.x", ">={a}.{b}.0 <2.0.0", "1.0.0 - {a}.{b}.9", "", "^1.0.0-rc.0 || 3", "<2", "{a}.{b}.1", "git+https://x/y", ">1.{b}", "latest"]
#: What each form asks of a version, k being its numbers with 0 for a release candidate and 1 for a release.
_PYPI_SQL = [
    "k >= [a, b, 0, 1] AND major < 2", "k >= [a, b, 0, 1] AND major = a", "major = a", "NOT (major = a AND minor = b) AND k >= [a, 0, 0, 1]", None, None, "k > [2, 0, 0, 1]",
    "k < [a, b, 1, 0]", "k = [a, b, 0, 1]", None, "k <= [1, 3, 2, 1]", "k >= [a, b, 1, 1] AND major = a AND minor = b",
]
_NPM_SQL = [
    "rc = 0 AND k >= [a, b, 0, 1] AND major = a", "rc = 0 AND major = a AND minor = b", "rc = 0 AND major = a", "rc = 0 AND k >= [a, b, 0, 1] AND major < 2", "rc = 0 AND k >= [1, 0, 0, 1] AND k <= [a, b, 9, 1]",
    None, "major = 1 AND (rc = 0 OR (minor = 0 AND patch = 0))", "rc = 0 AND major < 2", "k = [a, b, 1, 1]", None, "rc = 0 AND k[1:2] > [1, b]", None,
]


def _said(forms: list[str]) -> str:
    """The specifier of a part in Spark's SQL."""
    one = lambda f: "concat('" + f.replace("{a}", f"', {_A}, '").replace("{b}", f"', {_B}, '") + "')"
    return f"CASE {_FORM} " + " ".join(f"WHEN {i} THEN {one(f)}" for i, f in enumerate(forms)) + " END"


def _parts(spark, sf):
    """The keys of parts, dealt again: the table is one file, and what is made of a row costs far more than to read it."""
    return D.table(spark, sf, "part").select("p_partkey").repartition("p_partkey")


def registry(spark, sf):
    """(ecosystem, name, version, latest) of every part: twelve versions, some of them release candidates, some twice."""
    each = _parts(spark, sf).select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).selectExpr("p_partkey", *[f"{e} AS {n}" for n, e in _NUMBERS.items()])
    mark = f"CASE WHEN rc = 0 THEN '' WHEN {_ECO} = 'npm' THEN '-rc.1' ELSE 'rc1' END"
    return each.selectExpr(f"{_ECO} AS ecosystem", "concat('lib', p_partkey) AS name", f"concat(major, '.', minor, '.', patch, {mark}) AS version", "CASE WHEN p_partkey % 5 > 0 THEN '1.0.0' END AS latest")


def version_resolve(spark, sf):
    """The version that each part's specifier resolves to in a registry of twelve versions a part."""
    specs = _parts(spark, sf).selectExpr("p_partkey", f"{_ECO} AS ecosystem", "concat('lib', p_partkey) AS name", f"CASE WHEN {_ECO} = 'npm' THEN {_said(_NPM)} ELSE {_said(_PYPI)} END AS specifier")
    return versions.resolve(specs, registry(spark, sf)).select("p_partkey", "version")


def _fits_sql() -> str:
    case = lambda forms: "CASE form " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms) if f) + " ELSE false END"
    return f"CASE WHEN eco = 'npm' THEN {case(_NPM_SQL)} ELSE {case(_PYPI_SQL)} END"


_VERSION_SQL = f"""WITH e AS (SELECT p_partkey, {_ECO} AS eco, p_partkey // 2 % 12 AS form, 1 + p_partkey // 2 % 2 AS a, p_partkey // 4 % 4 AS b, i FROM part, range(12) r(i)),
 n AS (SELECT *, {", ".join(f"{e.replace(' div ', ' // ')} AS {c}" for c, e in _NUMBERS.items())} FROM e),
 v AS (SELECT *, [major, minor, patch, 1 - rc] AS k, major || '.' || minor || '.' || patch || CASE WHEN rc = 0 THEN '' WHEN eco = 'npm' THEN '-rc.1' ELSE 'rc1' END AS version FROM n),
 f AS (SELECT *, {_fits_sql()} AS fits, form IN (4, 5, 9) AND eco = 'pypi' OR form IN (5, 9, 11) AND eco = 'npm' AS newest FROM v)
 SELECT p_partkey, CASE WHEN any_value(newest) THEN CASE WHEN p_partkey % 5 > 0 THEN '1.0.0' ELSE max_by(version, k) FILTER (rc = 0) END
   WHEN any_value(eco) = 'npm' THEN max_by(version, k) FILTER (fits) ELSE coalesce(max_by(version, k) FILTER (fits AND rc = 0), max_by(version, k) FILTER (fits)) END AS version FROM f GROUP BY p_partkey"""


# --- manifests of four kinds ------------------------------------------------------------------------
_KEY = "CAST(s_suppkey AS STRING)"
_MANIFESTS = [
    ("pyproject.toml", "s_suppkey % 5 < 2", f"concat('[project]\\nname = \"lib', {_KEY}, '\"\\ndependencies = [', CASE WHEN s_suppkey % 5 = 0 THEN concat('\"Alpha_{{k}}>=1.', {_KEY}, '\", \"beta[x]; extra == \\'dev\\'\", \"alpha-{{k}}<9\", \"gamma\"') ELSE '' END, ']\\n')"),
    ("lib.dist-info/METADATA", "s_suppkey % 5 IN (1, 2)", f"concat('Metadata-Version: 2.1\\nRequires-Dist: delta', {_KEY}, ' (>=2)\\nRequires-Dist: eps ; extra == \"x\"\\nRequires-Dist:zeta~=1.0\\n\\nbody Requires-Dist: no\\n')"),
    ("lib.egg-info/requires.txt", "s_suppkey % 5 IN (2, 3)", f"concat('eta==', {_KEY}, '\\n\\n  theta  \\n[dev]\\niota\\n')"),
    ("package.json", "s_suppkey % 5 = 4", f"concat('{{\"name\": \"n\", \"dependencies\": {{\"@k/lambda\": \"^', {_KEY}, '\", \"mu\": \"1.x\", \"nu\": \"\"}}}}')"),
]


def declared_requirements(spark, sf):
    """What each supplier's manifests declare: the first kind of four that declares anything."""
    s = D.table(spark, sf, "supplier")
    files = None
    for rel, who, text in _MANIFESTS:
        own = s.where(who).selectExpr("s_suppkey AS package_id", f"'{rel}' AS rel", text.replace("{k}", "k") + " AS text")
        files = own if files is None else files.unionByName(own)
    return requirements.declared(files).select(F.col("package_id").alias("s_suppkey"), "name", "specifier")


_DECLARED_SQL = """SELECT s_suppkey, name, specifier FROM (
 SELECT s_suppkey, unnest(CASE s_suppkey % 5 WHEN 0 THEN [{'name': 'alpha-k', 'specifier': '>=1.' || s_suppkey}, {'name': 'gamma', 'specifier': NULL}]
   WHEN 1 THEN [{'name': 'delta' || s_suppkey, 'specifier': '>=2'}, {'name': 'zeta', 'specifier': '~=1.0'}] WHEN 2 THEN [{'name': 'delta' || s_suppkey, 'specifier': '>=2'}, {'name': 'zeta', 'specifier': '~=1.0'}]
   WHEN 3 THEN [{'name': 'eta', 'specifier': '==' || s_suppkey}, {'name': 'theta', 'specifier': NULL}]
   ELSE [{'name': '@k/lambda', 'specifier': '^' || s_suppkey}, {'name': 'mu', 'specifier': '1.x'}, {'name': 'nu', 'specifier': NULL}] END, recursive := true) FROM supplier)"""


# --- names against a table of prefixes, a hundred for each hundred of parts ---------------------------
def profile_by_prefix(spark, sf):
    """The profile of each part's name by a table with as many prefixes as there are parts; those of longer prefixes go first."""
    p = D.table(spark, sf, "part").select("p_partkey")
    name = "concat(CASE WHEN p_partkey % 3 = 0 THEN '@s' ELSE 'x-' END, CAST(p_partkey AS STRING), '/tail')"
    prefix = "concat(CASE WHEN p_partkey % 3 = 0 THEN '@s' ELSE 'x-' END, CAST(p_partkey div 2 AS STRING))"
    prefixes = p.selectExpr("CASE WHEN p_partkey % 7 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem", f"{prefix} AS prefix", f"{D.pick('p_partkey % 4', ['cloud-sdk', 'observability', 'web-framework', 'build-tool'])} AS profile", f"CAST(1000000000 AS BIGINT) * (9 - length({prefix})) + p_partkey AS priority")
    names = p.selectExpr("p_partkey", "'npm' AS ecosystem", f"{name} AS name")
    found = profiles.by_prefix(names.select("ecosystem", "name").distinct(), prefixes)
    return names.join(found, ["ecosystem", "name"], "left").select("p_partkey", F.col("_prefixed").alias("profile"))


_PREFIX_SQL = f"""WITH x AS (SELECT concat(CASE WHEN p_partkey % 3 = 0 THEN '@s' ELSE 'x-' END, CAST(p_partkey // 2 AS VARCHAR)) AS prefix, {D.pick('p_partkey % 4', ['cloud-sdk', 'observability', 'web-framework', 'build-tool'])} AS profile, p_partkey AS o FROM part WHERE p_partkey % 7 <> 0),
 n AS (SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN '@s' ELSE 'x-' END, CAST(p_partkey AS VARCHAR), '/tail') AS name FROM part),
 c AS (SELECT p_partkey, substr(name, 1, l) AS prefix FROM n, range(1, 20) r(l) WHERE l <= length(name))
 SELECT p_partkey, min_by(profile, 1000000000 * (9 - length(prefix)) + o) AS profile FROM n LEFT JOIN (SELECT * FROM c JOIN x USING (prefix)) m USING (p_partkey) GROUP BY p_partkey"""


# --- calls by other names, sockets and variables, each with the part's key in it ------------------------
#: (code, kind, line, detail, fqn, host or name of a variable) with {k} for the key of a part.
_CALLS = [
    ("import requests as r\\nr.get(\"https://h{k}.dev/x\")", "outbound_network", 2, "r.get(''https://h{k}.dev/x'')", "requests.get", "h{k}.dev"),
    ("from subprocess import Popen as P\\nx = 1\\nP([{k}])", "subprocess", 3, "P([{k}])", "subprocess.Popen", None),
    ("import socket as s\\ns.socket().connect\\ns.socket.connect(({k}, 80))", "outbound_dynamic", 3, "s.socket.connect(({k}, 80))", "socket.socket.connect", None),
    ("import socket\\nsocket.server.listen({k})", "listening_port", 2, "socket.server.listen({k})", "socket.server.listen", None),
    ("import os\\nx = os.environ[\"TOKEN_{k}\"]", "env_secret_read", 2, "os.environ[''TOKEN_{k}'']", None, None),
    ("from os import environ as e\\ny = e.get(\"MY_SECRET{k}\")", "env_secret_read", 2, "os.environ.get(''MY_SECRET{k}'')", None, "MY_SECRET{k}"),
    ("import socketserver as z\\nz.TCPServer((1, {k}), H)", "listening_port", 2, "z.TCPServer((1, {k}), H)", "socketserver.TCPServer", None),
    ("import numpy as requests\\nrequests.get(\"https://h{k}.dev\")", None, None, None, None, None),
]


def _keyed(texts: list[str | None], index: str, key: str = "CAST(p_partkey AS STRING)") -> str:
    """A CASE of texts with the key in them, in Spark's SQL and in any other."""
    one = lambda t: "NULL" if t is None else "concat('" + t.replace("{k}", f"', {key}, '") + "')"
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {one(t)}" for i, t in enumerate(texts)) + " END"


def python_calls(spark, sf):
    """Findings of a source for each part: calls through other names, sockets, variables; some lines further down, as the key says."""
    text = f"concat(repeat('\\n', CAST(p_partkey % 7 AS INT)), {_keyed([c[0] for c in _CALLS], 'p_partkey % 8')})"
    files = D.table(spark, sf, "part").selectExpr("p_partkey", "'m.py' AS rel", "'python' AS language", f"{text} AS text")
    return python_ast.detect(files, ("p_partkey", "rel")).select("p_partkey", "kind", "line", "detail", "fqn", F.coalesce("host", "env_name").alias("names"))


_CALLS_SQL = f"""SELECT p_partkey, {D.pick('p_partkey % 8', [c[1] for c in _CALLS])} AS kind, CAST(p_partkey % 7 + {D.pick('p_partkey % 8', [c[2] for c in _CALLS])} AS INT) AS line,
 {_keyed([c[3] for c in _CALLS], 'p_partkey % 8')} AS detail, {D.pick('p_partkey % 8', [c[4] for c in _CALLS])} AS fqn, {_keyed([c[5] for c in _CALLS], 'p_partkey % 8')} AS names FROM part WHERE p_partkey % 8 < 7"""


# --- code, its baseline and its tree ----------------------------------------------------------------
CODE = [
    'value = 1\\n',
    'import subprocess\\nsubprocess.run([1])\\n',
    'import requests\\nrequests.get("https://one.dev/x")\\n',
    'import subprocess, requests\\nsubprocess.run([1])\\nrequests.get("https://one.dev/x")\\n',
    'import subprocess\\nsubprocess.run([1])\\nsubprocess.Popen([2])\\neval(input())\\n',
    'import requests\\nrequests.get("https://two.dev/y")\\nrequests.post("https://one.dev/x")\\nexec(data)\\nexec(data)\\nexec(data)\\n',
]
#: (code, kind, findings, surface): what is in each code; a surface of null has a place of its own for each finding.
SURFACES = [
    (1, "subprocess", 1, "subprocess.run"), (2, "outbound_network", 1, "one.dev"), (2, "hardcoded_host", 1, "one.dev"),
    (3, "subprocess", 1, "subprocess.run"), (3, "outbound_network", 1, "one.dev"), (3, "hardcoded_host", 1, "one.dev"),
    (4, "subprocess", 1, "subprocess.run"), (4, "subprocess", 1, "subprocess.Popen"), (4, "obfuscation", 1, None),
    (5, "outbound_network", 1, "two.dev"), (5, "outbound_network", 1, "one.dev"), (5, "hardcoded_host", 1, "two.dev"), (5, "hardcoded_host", 1, "one.dev"), (5, "obfuscation", 3, None),
]


def _code_files(s, which: str, version: str, package: str):
    """A manifest and a module of each supplier: ``which`` code, at ``version``."""
    project = f"concat('[project]\\nname = \"lib', {_KEY}, '\"\\nversion = \"', {version}, '\"\\n')"
    rows = s.selectExpr(f"{package} AS package_id", f"explode(array(struct('pyproject.toml' AS rel, 'text' AS language, {project} AS text), struct('lib/main.py' AS rel, 'python' AS language, {D.pick(which, CODE)} AS text))) AS f")
    return rows.select("package_id", "f.*")


def _library_rows(s, accepted: str):
    """One journal row for each supplier's first version: accepted, or blocked where ``accepted`` says no."""
    rows = s.selectExpr("s_suppkey AS seq", "'put' AS op", "'pypi' AS ecosystem", f"concat('lib', {_KEY}) AS name", "'1.0' AS version", f"concat('h', {_KEY}) AS target_hash", "'2024-01-01' AS audited_at", "'plugin' AS profile",
                        f"CASE WHEN {accepted} THEN 'accepted' ELSE 'blocked-suspicious' END AS status", "90 AS score", "0.25D AS role_typical_share")
    return journal.index(rows)


def _kept(found, s):
    of = s.selectExpr(f"concat('old-', {_KEY}) AS package_id", "'pypi' AS kept_ecosystem", f"concat('lib', {_KEY}) AS kept_name", f"concat('h', {_KEY}) AS kept_hash")
    return found.join(of, "package_id").drop("package_id")


_WHICH, _BEFORE = "s_suppkey % 6", "s_suppkey div 6 % 6"


def preflight_verdicts(spark, sf):
    """The verdict on every supplier's package against the accepted version before: files, report, baseline, drift, verdict."""
    s = D.table(spark, sf, "supplier")
    specs = s.selectExpr(f"concat('new-', {_KEY}) AS package_id", "'pypi' AS ecosystem", f"concat('lib', {_KEY}) AS name", "'1.1' AS version", "s_suppkey")
    rows = _library_rows(s.where("s_suppkey % 4 > 0"), "s_suppkey % 4 > 1")
    before = audit.report(_code_files(s, _BEFORE, "'1.0'", f"concat('old-', {_KEY})"))[1]
    kept = _kept(before, s)
    judged, _ = preflight.preflight(specs.drop("s_suppkey"), _code_files(s, _WHICH, "'1.1'", f"concat('new-', {_KEY})"), rows, kept)
    return judged.join(specs.select("package_id", "s_suppkey"), "package_id").select("s_suppkey", "status", "score", "n_findings", "n_new", "write_status", F.array_join("reasons", "; ").alias("reasons"))


_PREFLIGHT_SQL = f"""WITH {_WEIGHTS}, f AS (SELECT * FROM {D.values(SURFACES, 't(code, kind, n, surface)')}),
 p AS (SELECT s_suppkey, s_suppkey % 6 AS code, s_suppkey // 6 % 6 AS old, s_suppkey % 4 AS kept FROM supplier),
 d AS (SELECT code, f.kind, sum(n) AS n, CASE WHEN f.kind = 'obfuscation' THEN least(least(any_value(dyn_per) * sum(n), any_value(dyn_cap)), any_value(cap)) ELSE least(any_value(per_finding) * sum(n), any_value(cap)) END AS deducted,
   any_value(role_typical) AS typical FROM f JOIN w ON w.kind = f.kind AND w.profile = 'plugin' WHERE cap > 0 GROUP BY code, f.kind),
 s AS (SELECT code, greatest(0, 100 - sum(deducted)) AS score, sum(deducted) FILTER (typical) AS typical, sum(deducted) AS deducted FROM d GROUP BY code),
 new AS (SELECT s_suppkey, a.kind, a.n FROM p JOIN f a ON a.code = p.code WHERE kept > 1 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.code = p.old AND b.kind = a.kind AND (b.surface = a.surface OR (b.surface IS NULL AND p.old = p.code)))),
 n AS (SELECT s_suppkey, sum(n) AS n_new, string_agg(DISTINCT kind, ', ' ORDER BY kind) FILTER (kind IN ({D.quoted(C.HIGH_RISK_KINDS)})) AS novel FROM new GROUP BY s_suppkey),
 v AS (SELECT p.*, CAST(coalesce(s.score, 100) AS INT) AS score, coalesce((SELECT sum(n) FROM f WHERE f.code = p.code), 0) AS n_findings, coalesce(n_new, 0) AS n_new, novel, round_even(coalesce(s.typical, 0) / coalesce(s.deducted, 1), 3) AS share
   FROM p LEFT JOIN s USING (code) LEFT JOIN n USING (s_suppkey)),
 r AS (SELECT *, CASE WHEN kept > 1 THEN concat_ws('; ', CASE WHEN score < {C.MIN_SCORE} THEN 'score ' || score || ' below threshold {C.MIN_SCORE}' END, CASE WHEN novel IS NOT NULL THEN 'novel high-risk surfaces vs. baseline: ' || novel END) ELSE
   concat_ws('; ', 'no prior baseline in library', CASE WHEN kept = 1 THEN 'prior blocked encounters for lib' || s_suppkey || ': 1.0 (blocked-suspicious, share=25%)' END, CASE WHEN score < {C.MIN_SCORE} THEN 'score ' || score || ' below threshold {C.MIN_SCORE}' END,
     CASE WHEN score < {C.MIN_SCORE} THEN 'library-status: ' || CASE WHEN share >= 0.8 THEN 'blocked-role-typical' ELSE 'blocked-suspicious' END || ' (role_typical_share=' || printf('%.2f', share) || ')' END,
     CASE WHEN score >= {C.AUTO_ACCEPT_SCORE} THEN 'auto-baselined (score ' || score || ' >= {C.AUTO_ACCEPT_SCORE})' WHEN score >= {C.MIN_SCORE} THEN 'first encounter: review and accept lib' || s_suppkey || '==1.1 to baseline it' END) END AS reasons FROM v)
 SELECT s_suppkey, CASE WHEN kept > 1 THEN CASE WHEN reasons = '' THEN 'safe' ELSE 'drift' END WHEN score < {C.MIN_SCORE} THEN 'low-score' WHEN score >= {C.AUTO_ACCEPT_SCORE} THEN 'first-encounter-accepted' ELSE 'first-encounter-needs-accept' END AS status,
   score, CAST(n_findings AS BIGINT) AS n_findings, CAST(n_new AS BIGINT) AS n_new,
   CASE WHEN kept > 1 THEN NULL WHEN score < {C.MIN_SCORE} THEN CASE WHEN share >= 0.8 THEN 'blocked-role-typical' ELSE 'blocked-suspicious' END WHEN score >= {C.AUTO_ACCEPT_SCORE} THEN 'accepted' END AS write_status, reasons FROM r"""

#: Versions of each supplier's package, and what a version declares; some specifiers have no version.
TREE_VERSIONS = ["1.0", "1.2", "2.0", "2.1rc1"]
_TREE_META = f"""concat('Name: lib', {_KEY}, '\\nRequires-Dist: lib', CAST(2 * s_suppkey AS STRING), CASE WHEN v = 2 THEN ' (>=1.1)' ELSE ' (<2)' END,
 '\\nRequires-Dist: Lib', CAST(2 * s_suppkey + 1 AS STRING), CASE s_suppkey % 4 WHEN 0 THEN '~=1.0' WHEN 1 THEN '' WHEN 2 THEN '>2' ELSE '==1.*,!=1.2' END,
 CASE WHEN s_suppkey % 5 = 0 THEN concat('\\nRequires-Dist: lib', CAST(s_suppkey div 3 AS STRING), '>=1') ELSE '' END, CASE WHEN s_suppkey % 11 = 0 THEN '\\nRequires-Dist: lib1 >9' ELSE '' END, '\\n')"""


def tree_inputs(spark, sf):
    """(roots, packages, files, registry, rows, kept) of a registry in which every supplier is a package of four versions."""
    s = D.table(spark, sf, "supplier").select("s_suppkey")
    each = s.select("s_suppkey", F.posexplode(F.array(*[F.lit(v) for v in TREE_VERSIONS])).alias("v", "version"))
    package = f"concat('lib', {_KEY}, '-', version)"
    packages = each.selectExpr(f"{package} AS package_id", "'pypi' AS ecosystem", f"concat('lib', {_KEY}) AS name", "version")
    meta = each.selectExpr(f"{package} AS package_id", "'lib.dist-info/METADATA' AS rel", "'text' AS language", f"{_TREE_META} AS text")
    files = _code_files(each.where("s_suppkey % 13 <> 12"), "(s_suppkey + v) % 6", "version", package).unionByName(meta.where("s_suppkey % 13 <> 12"))
    known = packages.select("ecosystem", "name", "version", F.when(F.col("name").endswith("7"), "1.2").alias("latest"))
    rows = _library_rows(s.where("s_suppkey % 3 = 0"), "s_suppkey % 9 > 0")
    before = audit.report(_code_files(s.where("s_suppkey % 9 > 0 AND s_suppkey % 3 = 0"), "s_suppkey % 6", "'1.0'", f"concat('old-', {_KEY})"))[1]
    kept = _kept(before, s)
    roots = s.selectExpr("'pypi' AS ecosystem", f"concat('Lib', {_KEY}) AS name", "CASE WHEN s_suppkey % 2 = 0 THEN '<2' END AS specifier")
    return roots, packages, files, known, rows, kept


def tree_audit(spark, sf):
    """Every supplier's package audited with all that it depends on: resolved, audited, judged and composed."""
    tree, _ = preflight.audit_tree(*tree_inputs(spark, sf))
    sizes = tree.groupBy("root").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("cycle").alias("n_cycles"), F.count_if("truncated").alias("n_truncated"), F.count_if(F.col("status") == "error").alias("n_errors"))
    return closure.composed_status(tree).join(sizes, "root")


def version_diffs(spark, sf):
    """What each supplier's code has and has lost against the code before it, and how its score moved."""
    s = D.table(spark, sf, "supplier")
    package = f"concat('lib', {_KEY})"
    specs = s.selectExpr(f"{package} AS package_id", "s_suppkey")
    summary, _, _ = preflight.version_diff(_code_files(s, _BEFORE, "'1.0'", package), _code_files(s, _WHICH, "'1.1'", package), specs.select("package_id"))
    return summary.join(specs, "package_id").select("s_suppkey", "score_delta", "n_new", "n_removed", "has_drift")


_SCORES = f"""{_WEIGHTS}, f AS (SELECT * FROM {D.values(SURFACES, 't(code, kind, n, surface)')}),
 d AS (SELECT code, profile, f.kind, CASE WHEN f.kind = 'obfuscation' THEN least(least(any_value(dyn_per) * sum(n), any_value(dyn_cap)), any_value(cap)) ELSE least(any_value(per_finding) * sum(n), any_value(cap)) END AS deducted
   FROM f JOIN w ON w.kind = f.kind WHERE cap > 0 GROUP BY code, profile, f.kind),
 s AS (SELECT code, profile, CAST(greatest(0, 100 - sum(deducted)) AS INT) AS score FROM d GROUP BY code, profile)"""
#: A surface without a name counts by its place, which is the same only in the same code.
_DIFF_SQL = f"""WITH {_SCORES}, p AS (SELECT s_suppkey, s_suppkey % 6 AS code, s_suppkey // 6 % 6 AS old FROM supplier),
 g AS (SELECT code, kind, coalesce(surface, 'code ' || code || ' ' || i) AS surface FROM f, range(1, 4) r(i) WHERE i <= n),
 c AS (SELECT s_suppkey, (SELECT count(*) FROM g a WHERE a.code = p.code AND NOT EXISTS (SELECT 1 FROM g b WHERE b.code = p.old AND b.kind = a.kind AND b.surface = a.surface)) AS n_new,
   (SELECT count(*) FROM g a WHERE a.code = p.old AND NOT EXISTS (SELECT 1 FROM g b WHERE b.code = p.code AND b.kind = a.kind AND b.surface = a.surface)) AS n_removed,
   coalesce((SELECT score FROM s WHERE s.code = p.code AND profile = 'plugin'), 100) - coalesce((SELECT score FROM s WHERE s.code = p.old AND profile = 'plugin'), 100) AS score_delta FROM p)
 SELECT s_suppkey, CAST(score_delta AS INT) AS score_delta, n_new, n_removed, n_new > 0 AS has_drift FROM c"""

def _pack(paths, texts) -> bytes:
    """A zip archive of texts, below one folder."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in sorted(zip(paths, texts)):
            z.writestr(f"top/{path}", text)
        z.writestr("../outside.py", "import os\nos.system('x')\n")
    return out.getvalue()


def archive_audit(spark, sf):
    """The score of each supplier's package from its archive, and which archives are broken: unpacked, rooted, audited."""
    s = D.table(spark, sf, "supplier")
    files = _code_files(s, _WHICH, "'1.0'", f"concat('lib', {_KEY})")

    @F.pandas_udf("binary")
    def pack(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_pack(p, t) for p, t in zip(paths, texts)], dtype=object)

    own = files.groupBy("package_id").agg(F.collect_list(F.struct("rel", "text")).alias("f"))  # the two files of a package
    archives = own.select("package_id", F.lit("pypi").alias("ecosystem"), F.concat("package_id", F.lit("-1.0.zip")).alias("path"), pack("f.rel", "f.text").alias("content"))
    broken = F.regexp_extract("package_id", r"(\d+)", 1).cast("int") % 9 == 4
    archives = cut(archives.withColumn("content", F.when(broken, F.expr("substring(content, 1, 40)")).otherwise(F.col("content"))))
    found, errors = S.from_archives(archives)
    reports, _ = audit.report(cut(found))
    out = archives.select("package_id").join(reports.select("package_id", "name", "version", "files_audited", "final_score", "n_findings"), "package_id", "left")
    return out.join(errors.groupBy("package_id").agg(F.max("error").alias("error")), "package_id", "left")


_ARCHIVE_SQL = """WITH {scores}, p AS (SELECT s_suppkey, 'lib' || s_suppkey AS package_id, s_suppkey % 6 AS code, s_suppkey % 9 = 4 AS broken FROM supplier)
 SELECT package_id, CASE WHEN NOT broken THEN package_id END AS name, CASE WHEN NOT broken THEN '1.0' END AS version, CASE WHEN NOT broken THEN 2 END::BIGINT AS files_audited,
  CASE WHEN NOT broken THEN coalesce((SELECT score FROM s WHERE s.code = p.code AND profile = 'plugin'), 100) END::INT AS final_score,
  CASE WHEN NOT broken THEN coalesce((SELECT sum(n) FROM f WHERE f.code = p.code), 0) END::BIGINT AS n_findings, CASE WHEN broken THEN package_id || '-1.0.zip: BadZipFile' END AS error FROM p"""


_PROFILES = ["plugin", "web-framework", None, "ml-framework"]


def refresh_audit(spark, sf):
    """The journal rows of auditing every supplier's accepted package again, at the profile it was accepted with; some have no files any more."""
    s = D.table(spark, sf, "supplier")
    package = f"concat('lib', {_KEY})"
    rows = s.selectExpr("s_suppkey AS seq", "'pypi' AS ecosystem", f"{package} AS name", "'1.0' AS version", "'old' AS target_hash", "CASE WHEN s_suppkey % 10 = 9 THEN 'blocked-suspicious' ELSE 'accepted' END AS status", f"{D.pick('s_suppkey % 4', _PROFILES)} AS profile", "50 AS score")
    wanted = library.to_refresh(rows, status="accepted")
    held = s.where("s_suppkey % 7 <> 3")
    packages = held.selectExpr(f"{package} AS package_id", "'pypi' AS ecosystem", f"{package} AS name", "'1.0' AS version")
    outcomes, written = library.refresh(wanted, packages, _code_files(held, _WHICH, "'1.0'", package), 1_000_000, "2024-03-01T00:00:00+00:00")
    appended = written.select("name", "seq", F.col("profile").alias("new_profile"), (F.length("target_hash") == 64).alias("hashed"), "refreshed_at")
    return outcomes.join(appended, "name", "left").select("name", "outcome", "old_score", "new_score", "status", "written", "seq", "new_profile", "hashed", "refreshed_at")


_REFRESH_SQL = f"""WITH {_SCORES}, p AS (SELECT 'lib' || s_suppkey AS name, s_suppkey % 6 AS code, coalesce({D.pick('s_suppkey % 4', _PROFILES)}, 'plugin') AS profile, s_suppkey % 7 <> 3 AS held FROM supplier WHERE s_suppkey % 10 <> 9),
 o AS (SELECT *, CASE WHEN held THEN coalesce((SELECT score FROM s WHERE s.code = p.code AND s.profile = p.profile), 100) END AS new_score FROM p),
 n AS (SELECT name, row_number() OVER (ORDER BY name) + 999999 AS seq FROM o WHERE held)
 SELECT name, CASE WHEN held THEN 'refreshed' ELSE 'error' END AS outcome, 50 AS old_score, CAST(new_score AS INT) AS new_score, 'accepted' AS status, held AS written, seq, CASE WHEN held THEN profile END AS new_profile,
   CASE WHEN held THEN true END AS hashed, CASE WHEN held THEN '2024-03-01T00:00:00+00:00' END AS refreshed_at FROM o LEFT JOIN n USING (name)"""


def as_events(table):
    """The table ``events`` as install candidates, records of past audits and withdrawals."""
    kinds = ["subprocess:a", "outbound_network:h", "obfuscation:x:1", "hardcoded_host:h"]
    surfaces = ", ".join(f"CASE WHEN event_id % {m} = 0 THEN '{k}' END" for m, k in zip((3, 4, 7, 2), kinds))
    rows = table.selectExpr(*[f"{e} AS {n}" for n, e in D.JOURNAL.items() if n not in ("op", "seq")], "event_id AS seq", "event_id % 9 = 0 AS critical", "event_id % 6 = 0 AS accept_new",
                            "CASE WHEN event_id % 50 = 7 THEN 'forget' WHEN event_id % 4 = 1 THEN 'record' ELSE 'candidate' END AS op", f"array_compact(array({surfaces})) AS surfaces")
    return rows.selectExpr(*[f"CAST({name} AS {kind}) AS {name}" for name, kind in (f.split() for f in verdicts.EVENT.split(", "))])


def stream_verdicts(spark, sf):
    """All events, judged as a stream with a state for each package; the table's files are one batch."""
    stream = spark.readStream.schema(D.table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    path = folder(spark, "verdicts")
    verdicts.run(as_events(stream), path, folder(spark, "stream")).awaitTermination()
    return spark.read.parquet(path).select("seq", "ecosystem", "name", "version", "status", "base_seq", F.array_join("novel", ",").alias("novel"), "prior", "write_status")


QUERIES = {
    "version_diffs": (version_diffs, _DIFF_SQL),
    "archive_audit": (archive_audit, _ARCHIVE_SQL.format(scores=_SCORES)),
    "refresh_audit": (refresh_audit, _REFRESH_SQL),
    "stream_verdicts": (stream_verdicts, None),
    "version_resolve": (version_resolve, _VERSION_SQL),
    "declared_requirements": (declared_requirements, _DECLARED_SQL),
    "python_calls": (python_calls, _CALLS_SQL),
    "profile_by_prefix": (profile_by_prefix, _PREFIX_SQL),
    "preflight_verdicts": (preflight_verdicts, _PREFLIGHT_SQL),
    "tree_audit": (tree_audit, None),
}
