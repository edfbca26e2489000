"""Sweep, trusted-text and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import files as P
from ..functions import text as T
from ..operators import javascript, mcp, memory, python_ast, sweep
from ..sources import files as S
from ..sources import requirements
from . import derived as D

_OCTETS = C.IPV4.replace(r"\b(?<![\d.])", r"(?:^|[^\d.\w])")
_ROUTABLE = "NOT (regexp_matches(ip, '^(127\\.|0\\.|10\\.|169\\.254\\.|192\\.168\\.|192\\.0\\.2\\.|198\\.51\\.100\\.|203\\.0\\.113\\.)') OR (split_part(ip, '.', 1) = '172' AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31) OR CAST(split_part(ip, '.', 1) AS INT) >= 224)"
_URL = C.URL.replace("'", "''")
_DOC_LINES = D.lines_sql("documents", "text", "doc_id")


def _doc_lines(spark, sf, hint=None):
    return sweep.code_lines(D.documents_as_files(spark, sf), ("doc_id",), comments=True, hint=hint)


def ipv4_sweep(spark, sf):
    return sweep.find_ipv4(_doc_lines(spark, sf, sweep.IPV4_HINT), ("doc_id",)).select("doc_id", "line", "host")


def ipv4_nonroutable(spark, sf):
    found = sweep.matches(_doc_lines(spark, sf, sweep.IPV4_HINT), C.IPV4, ("doc_id",), 1)
    return found.groupBy(T.non_routable(F.col("part")).alias("non_routable")).agg(F.count(F.lit(1)).alias("n"))


def line_numbers(spark, sf):
    return _doc_lines(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line").alias("last_line"), F.sum(F.length("said")).alias("chars"))


def url_sweep_pages(spark, sf):
    """Hosts in the addresses of pages (line 1) and in their HTML."""
    p = D.table(spark, sf, "pages").select("page_id", F.lit("text").alias("language"), F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit(""))).alias("text"))
    return sweep.find_urls(sweep.code_lines(p, ("page_id",), hint=sweep.URL_HINT), ("page_id",)).select("page_id", "line", "kind", "detail", "host")


def text_columns(spark, sf):
    """Texts of reports: a detail on one line, a hint, a share, a time, a host, a summary."""
    p = D.table(spark, sf, "part").withColumn("n", F.col("p_partkey"))
    said = F.concat(F.lit("  call\t "), F.expr("repeat('ab  c\n', CAST(n % 60 AS INT))"), F.col("n").cast("string"), F.lit(" "))
    extra = F.struct(F.when(F.col("n") % 3 == 0, F.lit("h.io")).alias("host"), F.when(F.col("n") % 2 == 0, "f.g").alias("fqn"), F.lit("").alias("name"), F.lit(None).cast("string").alias("env_name"), F.when(F.col("n") % 5 == 0, "write").alias("method"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 3607)
    reasons = F.when(F.col("n") % 4 == 0, F.array(F.lit("low"), F.lit("new"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        "p_partkey", T.collapse(said).alias("detail"), T.finding_hint(extra, F.lit("a/b.py"), F.col("n")).alias("hint"), T.percent(F.col("n") % 1001 / 1000.0).alias("share"), T.iso_seconds(at).alias("at"),
        T.url_host(F.concat(F.lit("see HTTP s https://Ab"), F.col("n").cast("string"), F.lit(".Example.io:80/x"))).alias("host"), T.verdict_summary(F.col("n") % 2 == 0, F.lit("p==1"), F.lit("drift"), reasons).alias("summary"),
    )


_HOSTS = ["sentry.io", "localhost", "example.com", "x.example.org", "a.test", "api.segment.io", "evil.io", "www.sentry.io"]


def _urls(spark, sf):
    p = D.table(spark, sf, "pages")
    return p.select("page_id", F.concat(F.lit("see https://"), F.expr(D.pick("page_id % 8", _HOSTS)), F.lit(":8443/p/"), F.col("page_id").cast("string"), F.lit(" now")).alias("text"), F.lit("text").alias("language"))


_URLS_SQL = f"u AS (SELECT page_id, {D.pick('page_id % 8', _HOSTS)} AS host FROM pages)"


def url_telemetry_classify(spark, sf):
    found = sweep.find_urls(sweep.code_lines(_urls(spark, sf), ("page_id",)), ("page_id",))
    return found.select("page_id", "host", "kind", "detail")


_NAMES = ["process.env.API_KEY", "os.getenv('DB_PASSWORD')", "os.environ['HOME']", "process.env.PORT", "x = 1", "os.environ['AWS_SECRET']"]


def env_secret_refs(spark, sf):
    p = D.table(spark, sf, "pages").select("page_id", F.concat(F.lit("a "), F.expr(D.pick("page_id % 6", [n.replace("'", '"') for n in _NAMES]))).alias("text"), F.lit("text").alias("language"))
    return sweep.find_env_secrets(sweep.code_lines(p, ("page_id",), comments=True), ("page_id",)).select("page_id", "env_name")


def base64_entropy(spark, sf):
    p = D.table(spark, sf, "pages")
    hex_ = F.concat(*[F.md5(F.concat(F.col("page_id").cast("string"), F.lit(s))) for s in "abcd"])
    mixed = F.when(F.col("page_id") % 2 == 0, F.concat(hex_, F.upper(F.substring(hex_, 1, 64)), F.lit("ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"))).otherwise(F.repeat(F.lit("ab"), 80))
    files = p.select("page_id", F.concat(F.lit("'"), mixed, F.lit("'")).alias("text"), F.lit("text").alias("language"))
    found = sweep.find_blobs(sweep.code_lines(files, ("page_id",), comments=True), ("page_id",))
    return found.select("page_id", "length", F.round("entropy", 1).alias("entropy"))


def content_hash_by_source(spark, sf):
    return S.content_hash(D.documents_as_files(spark, sf)).select("package_id", "target_hash")


_FOLDERS = ["", "src/", "node_modules/x/", "dist/", "a/.git/", "build/lib/", "x/__pycache__/", "venv/", "lib/Deep/er/", "docs/.ruff_cache/", "distribution/"]
_FILES = ["main.py", "index.JS", "README", "LICENSE", "logo.png", "types.d.ts", "data.tar.gz", ".gitignore", "x.mjs", "notes.md", "conf.toml", "noext", "Component.TSX", "dist", "setup.cfg", "a.ipynb", "Makefile"]
#: A path for each part, the same in Spark and in SQL.
_PATH = f"concat({D.pick('p_partkey % 11', _FOLDERS)}, {D.pick('p_partkey % 17', _FILES)})"
_PATHS_SQL = f"q AS (SELECT p_partkey, rel, string_split(rel, '/') AS parts FROM (SELECT p_partkey, {_PATH} AS rel FROM part))"


def _paths(spark, sf):
    return D.table(spark, sf, "part").selectExpr("p_partkey", f"{_PATH} AS rel")


def skip_dir_prune(spark, sf):
    return _paths(spark, sf).where(~P.skipped(F.col("rel"))).select("p_partkey", "rel")


def skip_dir_prune_package(spark, sf):
    return _paths(spark, sf).where(~P.skipped(F.col("rel"), True)).select("p_partkey", "rel")


def language_classify(spark, sf):
    return _paths(spark, sf).select("p_partkey", P.language(F.col("rel")).alias("language"))


def _lines(spark, sf):
    return memory.blob_lines(D.blobs(spark, sf), ("source", "turn"))


def _signals(spark, sf, signal):
    return memory.find_signals(_lines(spark, sf), ("source", "turn")).where(F.col("signal") == signal).select("source", "turn", "line", "kind", "detail")


def _pattern_sql(*patterns):
    """SQL for every match on every line; RE2 has no flags for what these patterns need but (?i)."""
    each = [f"SELECT source, turn, line, '{k}' AS kind, trim(unnest(regexp_extract_all(said, '{p}'))) AS detail FROM lines" for p, k in patterns]
    return f"WITH {D.BLOBS_SQL}, {D.lines_sql('blobs', 'blob', 'source, turn')} " + " UNION ALL ".join(each)


def memory_role_tags(spark, sf):
    return _signals(spark, sf, "role-tag")


def memory_override(spark, sf):
    return _signals(spark, sf, "instruction-override")


def memory_auto_confirm(spark, sf):
    return _signals(spark, sf, "auto-confirm-directive")


def memory_exfil(spark, sf):
    return _signals(spark, sf, "exfil-phrase")


def memory_framing_tags(spark, sf):
    return _signals(spark, sf, "framing-tag")


def memory_zero_width(spark, sf):
    b = D.blobs(spark, sf).withColumn("blob", F.when(F.col("turn") % 3 == 1, F.concat("blob", F.lit("\nx\u200bx"))).otherwise(F.col("blob")))
    return memory.find_zero_width(memory.blob_lines(b, ("source", "turn")), ("source", "turn")).select("source", "turn", "kind", "signal")


def memory_anomalies(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("blob"))
    return memory.find_anomalies(d, ("doc_id",)).select("doc_id", "line", "detail", "signal")


def memory_summary_level(spark, sf):
    b = D.blobs(spark, sf)
    keys = ("source", "turn")
    return memory.summarize(memory.scan(b, keys), b, keys).select("source", "turn", "level", "message")


def memory_approvals(spark, sf):
    """The journal rows that approve every turn's text, with the version after the last one of its source and the level of what was found in it."""
    b = D.blobs(spark, sf).select(F.concat_ws("/", "source", F.col("turn").cast("string")).alias("source"), "turn", "blob")
    before = b.where("turn % 2 = 0").select("source", F.concat(F.lit("v"), (F.col("turn") + 3).cast("string")).alias("version"))
    out = memory.approve(b.drop("turn"), before, F.lit("2024-01-01T00:00:00+00:00"))
    return out.select("source", "version", "sha256", "blob_len", "status", "approved_at", "level")


def _approvals_sql():
    return f"""WITH {D.BLOBS_SQL}, l AS ({_summary_sql()}) SELECT b.source || '/' || b.turn AS source, CASE WHEN b.turn % 2 = 0 THEN 'v' || (b.turn + 4) ELSE 'v1' END AS version, sha256(blob) AS sha256, CAST(length(blob) AS INT) AS blob_len,
      'approved' AS status, '2024-01-01T00:00:00+00:00' AS approved_at, level FROM blobs b JOIN l ON l.source = b.source AND l.turn = b.turn"""


def _summary_sql():
    bank = " UNION ALL ".join(f"SELECT source, turn, '{k}' AS kind FROM (SELECT source, turn, unnest(regexp_extract_all(said, '{p}')) FROM lines)" for p, k, _ in C.MEMORY_PATTERNS)
    return f"""WITH {D.BLOBS_SQL}, {D.lines_sql('blobs', 'blob', 'source, turn')}, f AS ({bank}
      UNION ALL SELECT source, turn, 'obfuscation' FROM blobs WHERE length(blob) > 8000
      UNION ALL SELECT source, turn, 'obfuscation' FROM lines WHERE length(said) > 600
      UNION ALL SELECT source, turn, CASE host WHEN 'mixpanel.com' THEN 'telemetry_endpoint' ELSE 'hardcoded_host' END FROM (SELECT source, turn, unnest(regexp_extract_all(said, 'https?://([A-Za-z0-9.\\-_]+)', 1)) AS host FROM lines)
      UNION ALL SELECT source, turn, 'hardcoded_host' FROM (SELECT source, turn, unnest(regexp_extract_all(said, '{_OCTETS}', 1)) AS ip FROM lines) WHERE {_ROUTABLE}
      UNION ALL SELECT source, turn, 'env_secret_read' FROM (SELECT source, turn, unnest(regexp_extract_all(said, 'process\\.env\\.([A-Za-z0-9_]+)', 1)) AS nm FROM lines) WHERE regexp_matches(nm, '{C.SECRET_NAME}')),
      s AS (SELECT source, turn, count(*) FILTER (kind IN ({D.quoted(C.ADVERSE_KINDS)})) AS bad, count(*) FILTER (kind NOT IN ({D.quoted(C.ADVERSE_KINDS)})) AS mild,
        string_agg(DISTINCT kind, ', ' ORDER BY kind) FILTER (kind IN ({D.quoted(C.ADVERSE_KINDS)})) AS kinds FROM f GROUP BY ALL)
      SELECT b.source, b.turn, CASE WHEN bad > 0 THEN 'review' WHEN mild > 0 THEN 'caution' ELSE 'clean' END AS level,
        CASE WHEN bad > 0 THEN bad || ' adverse signal(s) (' || kinds || '); approve ONLY if you wrote or expected this exact text'
          WHEN mild > 0 THEN mild || ' informational finding(s) (e.g. embedded URL); verify they are legitimate references before approving'
          ELSE 'no injection signals detected; safe to approve' END AS message FROM (SELECT DISTINCT source, turn FROM blobs) b LEFT JOIN s ON s.source = b.source AND s.turn = b.turn"""


def _memory_journal(spark, sf):
    d = D.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("source"), F.concat(F.lit("v"), (F.col("doc_id") % 17 + 1).cast("string")).alias("version"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.when(F.col("doc_id") % 5 == 0, "revoked").otherwise("approved").alias("status"))


_MEMORY_SQL = "m AS (SELECT doc_id AS seq, source, 'v' || (doc_id % 17 + 1) AS version, sha256(coalesce(text, '')) AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'revoked' ELSE 'approved' END AS status FROM documents)"


def memory_approval_lookup(spark, sf):
    d = D.table(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("blob"))
    return memory.check(d, _memory_journal(spark, sf).where("seq % 3 <> 0")).groupBy("source", "reason_code", "approved").agg(F.count(F.lit(1)).alias("n"))


def memory_next_version(spark, sf):
    return memory.next_versions(_memory_journal(spark, sf))


def memory_latest_approved(spark, sf):
    return memory.latest_approved(_memory_journal(spark, sf)).select("source", "seq", "version", "sha256")


_CONFIGS = [
    '{"mcpServers": {"a": {"command": "npx", "args": ["-y", "pkg@1.0"]}}}',
    '{"mcpServers": {"b": {"args": ["pkg@latest"]}, "c": {"args": ["--yes", "x@latest"]}}}',
    '{"mcpServers": {"d": {"args": ["run", "latest"]}, "e": {}}}',
    "no json", '{"other": 1}',
]


def launch_config_drift(spark, sf):
    s = D.table(spark, sf, "supplier").selectExpr("s_suppkey", D.pick("s_suppkey % 2", ["conf/mcp.json", "conf/other.json"]) + " AS rel", D.pick("s_suppkey % 5", _CONFIGS) + " AS text")
    return mcp.launch_drift(s, ("s_suppkey", "rel")).select("s_suppkey", "server", "reason", "detail")


_DRIFT_ROWS = [
    (0, "a", "auto-accept", "server 'a' launched with auto-accept flag (-y pkg@1.0)"), (1, "b", "unpinned", "server 'b' pulls unpinned 'latest' version"),
    (1, "c", "auto-accept", "server 'c' launched with auto-accept flag (--yes x@latest)"), (1, "c", "unpinned", "server 'c' pulls unpinned 'latest' version"),
    (2, "d", "unpinned", "server 'd' pulls unpinned 'latest' version"),
]
_JS = ["server.tool('read_file', x)", "app.resource(\"notes/a\", y); server.prompt(`p`, z)", "s.setRequestHandler('tools/list', h)", "console.log(1)"]


def js_mcp_registrations(spark, sf):
    js = F.expr(D.pick("s_suppkey % 4", [x.replace("'", '"') for x in _JS]))
    s = D.table(spark, sf, "supplier").select("s_suppkey", F.lit("javascript").alias("language"), F.concat(F.lit("\n"), js).alias("text"))
    return mcp.js_registrations(s, ("s_suppkey",)).select("s_suppkey", "line", "kind", "name")


_JS_ROWS = [(0, "mcp_tool", "read_file"), (1, "mcp_resource", "notes/a"), (1, "mcp_resource", "p"), (2, "mcp_tool", "<handler>")]

_PY = [
    "import requests\nrequests.get('https://a.example.io/x')", "import os\nos.system('ls'); os.getenv('API_KEY')",
    "open('a', 'w').write('x')\neval(compile(x, y, z))", "import base64\nexec(base64.b64decode(s))", "@mcp.tool()\ndef f():\n    'doc'", "def broken(:",
]


def _sources(spark, sf, texts, language, modulus):
    s = D.table(spark, sf, "supplier")
    said = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("s_suppkey") % modulus + 1).cast("int"))
    return s.select("s_suppkey", F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("rel"), F.lit(language).alias("language"), said.alias("text"))


def python_detectors(spark, sf):
    found = python_ast.detect(_sources(spark, sf, _PY, "python", len(_PY)), ("s_suppkey", "rel"))
    return found.select("s_suppkey", "seq", "kind", "line", "fqn", "host", "shape")


_PY_ROWS = [
    (0, 0, "outbound_network", 2, "requests.get", "a.example.io", None), (1, 0, "subprocess", 2, "os.system", None, None), (1, 1, "env_secret_read", 2, None, None, None),
    (2, 0, "fs_write", 1, None, None, None), (2, 1, "obfuscation", 2, None, None, "dynamic"), (2, 2, "obfuscation", 2, None, None, "dynamic"),
    (3, 0, "obfuscation", 2, None, None, "encoded"), (4, 0, "mcp_tool", 2, None, None, None),
]
_JS_TEXTS = ["const cp = require('child_process');\ncp.exec('ls');", "fetch('https://b.example.io/', {t: authToken});", "app.listen(80); eval(x);", "process.env.MY_SECRET; // fetch(x)"]


def js_detectors(spark, sf):
    found = javascript.detect(_sources(spark, sf, _JS_TEXTS, "javascript", 4), ("s_suppkey", "rel"))
    return found.select("s_suppkey", "seq", "kind", "line", "fqn", "host")


_JS_FOUND = [
    (0, 0, "subprocess", 2, "child_process.exec", None), (1, 0, "outbound_network", 1, "fetch", "b.example.io"), (1, 1, "data_exfil_hint", 1, None, None),
    (2, 0, "listening_port", 1, "app.listen", None), (2, 1, "obfuscation", 1, "eval", None), (3, 0, "env_secret_read", 1, None, None),
]
_MASKED = ["x = 1\n# see https://a.io/1\ny = 'https://b.io/2'", '"""doc\nhttps://c.io/3\n"""\nz = "https://d.io/4"']


def line_mask(spark, sf):
    return sweep.find_urls(sweep.code_lines(_sources(spark, sf, _MASKED, "python", 2), ("s_suppkey",)), ("s_suppkey",)).select("s_suppkey", "line", "host")


_REQS = ["flask>=2\n-r more.txt\n# note", "Requests[socks] (>=1.0) ; python_version<'3'\nx; extra == 'y'"]


def requirement_includes(spark, sf):
    """The first specifier of each name that a supplier's requirement file declares, with what it includes."""
    s = D.table(spark, sf, "supplier")
    folder = F.concat(F.lit("/p"), F.col("s_suppkey").cast("string"))
    two = F.array(F.struct(F.lit("/a.txt").alias("rel"), F.lit(_REQS[0]).alias("text")), F.struct(F.lit("/more.txt").alias("rel"), F.lit(_REQS[1]).alias("text")))
    files = s.select(folder.alias("folder"), F.explode(two).alias("f")).select(F.concat("folder", "f.rel").alias("path"), "f.text")
    roots = s.select(F.col("s_suppkey").alias("root"), F.concat(folder, F.lit("/a.txt")).alias("path"))
    lines, _ = requirements.includes(roots, files)
    return requirements.parsed(lines, ("root",), "place").select(F.col("root").alias("package_id"), "name", "specifier")


def _of(rows, columns, modulus):
    """SQL: for each supplier the rows of its remainder."""
    names = ", ".join(columns)
    return f"SELECT s_suppkey, {names} FROM supplier JOIN (SELECT * FROM {D.values(rows, 't(r, ' + names + ')')}) t ON s_suppkey % {modulus} = r"


QUERIES = {
    "ipv4_sweep": (ipv4_sweep, f"WITH {_DOC_LINES}, m AS (SELECT doc_id, line, unnest(regexp_extract_all(said, '{_OCTETS}\\b', 1)) AS ip FROM lines) SELECT doc_id, line, ip AS host FROM m WHERE {_ROUTABLE}".replace(C.OCTET + ")\\b\\b", C.OCTET + ")\\b")),
    "ipv4_nonroutable": (ipv4_nonroutable, f"WITH {_DOC_LINES}, m AS (SELECT unnest(regexp_extract_all(said, '{_OCTETS}', 1)) AS ip FROM lines) SELECT NOT ({_ROUTABLE}) AS non_routable, count(*) AS n FROM m GROUP BY 1"),
    "line_numbers": (line_numbers, f"WITH {_DOC_LINES} SELECT doc_id, count(*) AS n_lines, max(line) AS last_line, CAST(sum(length(said)) AS BIGINT) AS chars FROM lines GROUP BY doc_id"),
    "url_sweep_pages": (url_sweep_pages, f"""WITH p AS (SELECT page_id, coalesce(url, '') || chr(10) || coalesce(html, '') AS text FROM pages), {D.lines_sql("p", "text", "page_id")},
      m AS (SELECT page_id, line, unnest(regexp_extract_all(said, '{_URL}')) AS detail, lower(unnest(regexp_extract_all(said, '{_URL}', 1))) AS host FROM lines)
      SELECT page_id, line, CASE WHEN host IN ({D.quoted(C.TELEMETRY_HOSTS)}) THEN 'telemetry_endpoint' ELSE 'hardcoded_host' END AS kind, detail, host FROM m
      WHERE host NOT IN ({D.quoted(C.LOCAL_HOSTS + C.DOC_HOSTS)}) AND NOT regexp_matches(host, '({"|".join(t.replace(".", chr(92) + ".") for t in C.DOC_TLDS)})$')"""),
    "text_columns": (text_columns, """WITH p AS (SELECT p_partkey, p_partkey AS n, trim(regexp_replace('  call ' || repeat('ab  c' || chr(10), CAST(p_partkey % 60 AS INT)) || p_partkey, '\\s+', ' ', 'g')) AS d FROM part),
      h AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'h.io ' WHEN n % 2 = 0 THEN 'f.g ' WHEN n % 5 = 0 THEN 'write ' ELSE '' END AS e FROM p)
      SELECT p_partkey, CASE WHEN length(d) > 200 THEN substr(d, 1, 200) || '...' ELSE d END AS detail, e || '[a/b.py:' || n || ']' AS hint, CAST(round_even(n % 1001 / CAST(1000 AS DOUBLE) * 100, 0) AS INT) || '%' AS share,
        strftime(make_timestamp((1700000000 + CAST(n AS BIGINT) * 3607) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS at, 'ab' || n || '.example.io' AS host,
        CASE WHEN n % 2 = 0 THEN 'BLOCK' ELSE 'OK' END || ' p==1: drift' || CASE WHEN n % 4 = 0 THEN ' (low; new)' ELSE '' END AS summary FROM h"""),
    "url_telemetry_classify": (url_telemetry_classify, f"WITH {_URLS_SQL} SELECT page_id, host, CASE WHEN host IN ('sentry.io', 'api.segment.io') THEN 'telemetry_endpoint' ELSE 'hardcoded_host' END AS kind, 'https://' || host || ':8443/p/' || page_id AS detail FROM u WHERE host NOT IN ('localhost', 'example.com', 'a.test')"),
    "env_secret_refs": (env_secret_refs, f"SELECT page_id, {D.pick('page_id % 6', ['API_KEY', 'DB_PASSWORD', None, None, None, 'AWS_SECRET'])} AS env_name FROM pages WHERE page_id % 6 IN (0, 1, 5)"),
    "base64_entropy": (base64_entropy, """WITH p AS (SELECT page_id, md5(page_id || 'a') || md5(page_id || 'b') || md5(page_id || 'c') || md5(page_id || 'd') AS h FROM pages WHERE page_id % 2 = 0),
      b AS (SELECT page_id, h || upper(substr(h, 1, 64)) || 'ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ' AS s FROM p), c AS (SELECT page_id, length(s) AS n, unnest(string_split(s, '')) AS ch FROM b),
      k AS (SELECT page_id, n, ch, count(*) AS c FROM c WHERE ch <> '' GROUP BY ALL) SELECT page_id, CAST(n AS INT) AS length, round(round(-sum(c / n * log2(c / n)), 2), 1) AS entropy FROM k GROUP BY page_id, n"""),
    "content_hash_by_source": (content_hash_by_source, "SELECT source AS package_id, sha256(string_agg('doc' || doc_id || '.txt' || chr(0) || coalesce(text, '') || chr(0), '' ORDER BY 'doc' || doc_id || '.txt', text)) AS target_hash FROM documents GROUP BY source"),
    "skip_dir_prune": (skip_dir_prune, f"WITH {_PATHS_SQL} SELECT p_partkey, rel FROM q WHERE NOT list_has_any(parts, [{D.quoted(C.SKIP_DIRS)}])"),
    "skip_dir_prune_package": (skip_dir_prune_package, f"WITH {_PATHS_SQL} SELECT p_partkey, rel FROM q WHERE NOT list_has_any(parts, [{D.quoted([d for d in C.SKIP_DIRS if d not in C.READMITTED_DIRS])}])"),
    "language_classify": (language_classify, f"""WITH {_PATHS_SQL}, n AS (SELECT p_partkey, lower(parts[-1]) AS name FROM q), e AS (SELECT *, regexp_extract(name, '^.+([.][^.]+)$', 1) AS ext FROM n)
      SELECT p_partkey, CASE WHEN ext IN ({D.quoted(C.PYTHON_SUFFIXES)}) THEN 'python' WHEN ext IN ({D.quoted(C.JS_SUFFIXES)}) THEN 'javascript' WHEN ext IN ({D.quoted(C.TEXT_SUFFIXES)}) OR name IN ({D.quoted(C.BARE_TEXT_NAMES)}) THEN 'text' ELSE 'binary' END AS language FROM e"""),
    "memory_role_tags": (memory_role_tags, _pattern_sql((C.ROLE_TAG, "prompt_injection_hint"))),
    "memory_override": (memory_override, _pattern_sql((C.INJECTION, "prompt_injection_hint"), (C.OVERRIDE, "prompt_injection_hint"))),
    "memory_auto_confirm": (memory_auto_confirm, _pattern_sql((C.AUTO_CONFIRM, "prompt_injection_hint"))),
    "memory_exfil": (memory_exfil, _pattern_sql((C.EXFIL, "data_exfil_hint"))),
    "memory_framing_tags": (memory_framing_tags, _pattern_sql((C.FRAMING_TAG, "prompt_injection_hint"))),
    "memory_zero_width": (memory_zero_width, "SELECT 'conv' || conv_id AS source, turn, 'obfuscation' AS kind, 'zero-width' AS signal FROM conversations WHERE turn % 3 = 1"),
    "memory_anomalies": (memory_anomalies, f"""WITH {_DOC_LINES} SELECT doc_id, 1 AS line, '<blob len=' || length(text) || ' > cap 8000>' AS detail, 'oversized-blob' AS signal FROM documents WHERE length(text) > 8000
      UNION ALL SELECT doc_id, line, '<line len=' || length(said) || ' > cap 600>', 'oversized-line' FROM lines WHERE length(said) > 600"""),
    "memory_summary_level": (memory_summary_level, _summary_sql()),
    "memory_approvals": (memory_approvals, _approvals_sql()),
    "memory_approval_lookup": (memory_approval_lookup, f"""WITH {_MEMORY_SQL}, l AS (SELECT source, sha256, arg_max(status, seq) AS status FROM m WHERE seq % 3 <> 0 GROUP BY ALL)
      SELECT d.source, CASE WHEN status IS NULL THEN 'unknown_content' WHEN status = 'approved' THEN 'approved' ELSE 'baseline_not_approved' END AS reason_code, coalesce(status = 'approved', false) AS approved, count(*) AS n
      FROM documents d LEFT JOIN l ON l.source = d.source AND l.sha256 = sha256(coalesce(d.text, '')) GROUP BY ALL"""),
    "memory_next_version": (memory_next_version, f"WITH {_MEMORY_SQL} SELECT source, 'v' || (max(CAST(substr(version, 2) AS INT)) + 1) AS next_version FROM m GROUP BY source"),
    "memory_latest_approved": (memory_latest_approved, f"WITH {_MEMORY_SQL} SELECT source, max(seq) AS seq, arg_max(version, seq) AS version, arg_max(sha256, seq) AS sha256 FROM m WHERE status = 'approved' GROUP BY source"),
    "launch_config_drift": (launch_config_drift, _of(_DRIFT_ROWS, ["server", "reason", "detail"], 5) + " WHERE s_suppkey % 2 = 0"),
    "js_mcp_registrations": (js_mcp_registrations, "SELECT s_suppkey, 2 AS line, kind, name FROM (" + _of(_JS_ROWS, ["kind", "name"], 4) + ")"),
    "python_detectors": (python_detectors, _of(_PY_ROWS, ["seq", "kind", "line", "fqn", "host", "shape"], 6)),
    "js_detectors": (js_detectors, _of(_JS_FOUND, ["seq", "kind", "line", "fqn", "host"], 4)),
    "line_mask": (line_mask, _of([(0, 3, "b.io"), (1, 4, "d.io")], ["line", "host"], 2)),
    "requirement_includes": (requirement_includes, "SELECT s_suppkey AS package_id, name, specifier FROM supplier CROSS JOIN (VALUES ('flask', '>=2'), ('requests', '>=1.0')) AS t(name, specifier)"),
}
