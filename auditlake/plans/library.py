"""Queries of the library: scans, lookups, accepting, refreshing, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from ..sources import journal, library
from . import derived as D

_I = f"WITH {D.INDEX_SQL} "


def _index(spark, sf):
    return journal.index(D.journal(spark, sf))


def _library_files(spark, sf):
    """The index as files: one index a package, and a report for all entries but some."""
    rows = _index(spark, sf)
    entry = F.struct("seq", F.struct("version", "target_hash", "audited_at", "score").alias("e"))
    packages = rows.groupBy("ecosystem", "name").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    index = packages.select(F.concat_ws("/", "ecosystem", "name", F.lit("_index.json")).alias("rel"), F.to_json(F.struct("name", "entries")).alias("text"))
    reports = rows.where("seq % 13 <> 0").select(F.concat_ws("/", "ecosystem", "name", "version", F.concat("target_hash", F.lit(".json"))).alias("rel"), F.to_json(F.struct("profile", "status")).alias("text"))
    return index.unionByName(reports)


def library_scan(spark, sf):
    return library.index_scan(_library_files(spark, sf)).select("ecosystem", "name", "ordinal", "version", "target_hash", "audited_at", "score", "profile", "status")


def library_size(spark, sf):
    listing = D.table(spark, sf, "events").selectExpr("concat(CASE WHEN user_id % 2 = 0 THEN 'pypi' ELSE 'npm' END, '/lib', CAST(user_id AS STRING)) AS rel", "CAST(floor(value) AS BIGINT) AS size")
    return library.size(listing).select(F.coalesce("ecosystem", F.lit("all")).alias("ecosystem"), "files", "bytes")


def library_known_hash(spark, sf):
    c = D.journal(spark, sf).where("op = 'put'").select(F.col("seq").alias("candidate"), "ecosystem", "name", F.when(F.col("seq") % 3 == 0, "new").otherwise(F.col("target_hash")).alias("target_hash"))
    return library.known_hashes(c, _index(spark, sf)).select("candidate", F.col("library.seq").alias("seq"), F.col("library.status").alias("status"))


def pinned_profile(spark, sf):
    specs = D.journal(spark, sf).where("op = 'put'").select(F.col("seq").alias("candidate"), "ecosystem", "name", "version")
    return library.pinned_profiles(specs, _index(spark, sf)).select("candidate", "pinned")


def pin_or_library(spark, sf):
    j = D.journal(spark, sf)
    project = F.concat(F.lit("p"), (F.col("seq") % 9).cast("string"))
    pins = j.where("seq % 20 = 0").select(project.alias("project"), "seq", "name", "target_hash")
    c = j.where("op = 'put'").select(project.alias("project"), F.col("seq").alias("candidate"), "ecosystem", "name", "target_hash")
    return library.resolved(c, pins, _index(spark, sf)).select("candidate", "base_hash", "base_from")


def accept_with_pins(spark, sf):
    f = D.findings(spark, sf)
    reports = f.groupBy("package_id").agg(F.max("profile").alias("profile")).select("package_id", F.lit("pypi").alias("ecosystem"), F.col("package_id").alias("name"), F.lit("1").alias("version"), F.concat(F.lit("h"), "package_id").alias("target_hash"), "profile")
    counts = scoring.surface_counts(f.where("file = 'src/main.py'"))
    rows = library.accept(reports, counts, 1000, "2024-01-01T00:00:00+00:00")
    said = F.array_join(F.transform(F.array_sort(F.map_entries("expected_surface_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("name", "seq", "status", "baselined_at", said.alias("pinned"))


def refresh_outcomes(spark, sf):
    """A refresh of some packages, each at the score it has plus one."""
    wanted = library.to_refresh(_index(spark, sf), ecosystem="pypi", name_like="LIB1", redetect=False)
    key = F.concat_ws("|", "ecosystem", "name", "version", "target_hash")
    audited = wanted.where("old_score % 5 <> 1").groupBy("ecosystem", "name", "version").agg(F.max("old_score").alias("m"))
    audited = audited.select("ecosystem", "name", "version", (F.col("m") + 1).alias("new_score"), F.when(F.col("m") % 7 == 0, "timed out").alias("error"))
    return library.refreshed(wanted, audited).select(key.alias("key"), "spec", "explicit", "old_score", "new_score", "outcome", F.coalesce("error", F.lit("")).alias("error"), "written")


def refresh_totals(spark, sf):
    return library.refresh_totals(refresh_outcomes(spark, sf))


def _memory(spark, sf):
    d = D.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("seq"), "source", F.concat(F.lit("v"), (F.col("doc_id") % 7 + 1).cast("string")).alias("version"), F.when(F.col("doc_id") % 31 == 5, "forget").otherwise("put").alias("op"), F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))).alias("approved_at"))


def memory_forget(spark, sf):
    rows = _memory(spark, sf)
    rows = rows.withColumn("version", F.when(~((F.col("op") == "forget") & (F.col("seq") % 2 == 0)), F.col("version")))
    return library.memory_list(library.memory_view(rows)).select("seq", "source", "version", "approved_at")


def json_rows(spark, sf):
    n = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, None).otherwise(F.col("n_regionkey").cast("long")).alias("region"))
    return library.as_json(n)


def text_rows(spark, sf):
    n = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, None).otherwise(F.col("n_regionkey")).alias("region"))
    return library.as_text(n, {"key": 4, "name": 10, "region": 8})


_BEST = "(SELECT {c} FROM ok WHERE ok.ecosystem = s.ecosystem AND ok.name = s.name{v} ORDER BY seq DESC LIMIT 1)"
_REFRESH = """, w AS (SELECT * FROM idx WHERE ecosystem = 'pypi' AND lower(name) LIKE '%lib1%'), a AS (SELECT name, version, max(score) AS m FROM w WHERE score % 5 <> 1 GROUP BY ALL),
  o AS (SELECT concat_ws('|', ecosystem, w.name, w.version, target_hash) AS key, w.name || '==' || w.version AS spec, profile AS explicit, score AS old_score, m,
    CASE WHEN m IS NULL OR m % 7 = 0 THEN 'error' ELSE 'refreshed' END AS outcome, CASE WHEN m IS NULL THEN 'not audited' WHEN m % 7 = 0 THEN 'timed out' ELSE '' END AS error FROM w LEFT JOIN a ON a.name = w.name AND a.version = w.version)"""

QUERIES = {
    "library_scan": (library_scan, _I + "SELECT ecosystem, name, CAST(row_number() OVER (PARTITION BY ecosystem, name ORDER BY seq) - 1 AS INT) AS ordinal, version, target_hash, audited_at, score, CASE WHEN seq % 13 <> 0 THEN profile END AS profile, coalesce(CASE WHEN seq % 13 <> 0 THEN status END, 'accepted') AS status FROM idx"),
    "library_size": (library_size, "WITH l AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, CAST(floor(value) AS BIGINT) AS size FROM events) SELECT ecosystem, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM l GROUP BY 1 UNION ALL SELECT 'all', count(*), CAST(sum(size) AS BIGINT) FROM l"),
    "library_known_hash": (library_known_hash, _I + "SELECT j.seq AS candidate, i.seq, i.status FROM journal j LEFT JOIN idx i ON i.ecosystem = j.ecosystem AND i.name = j.name AND i.target_hash = j.target_hash AND j.seq % 3 <> 0 WHERE j.op = 'put'"),
    "pinned_profile": (pinned_profile, _I + f", ok AS (SELECT * FROM idx WHERE coalesce(status, 'accepted') = 'accepted'), s AS (SELECT * FROM journal WHERE op = 'put'), b AS (SELECT seq AS candidate, coalesce({_BEST.format(c='seq', v=' AND ok.version = s.version')}, {_BEST.format(c='seq', v='')}) AS best FROM s) SELECT candidate, profile AS pinned FROM b LEFT JOIN ok ON ok.seq = best"),
    "pin_or_library": (pin_or_library, _I + f""", ok AS (SELECT * FROM idx WHERE coalesce(status, 'accepted') = 'accepted'), p AS (SELECT seq % 9 AS project, seq AS pseq, name AS pname, target_hash AS phash FROM journal WHERE seq % 20 = 0),
      s AS (SELECT *, (SELECT min(pseq) FROM p WHERE p.project = j.seq % 9 AND (pname = j.name OR phash = j.target_hash)) AS pin FROM journal j WHERE op = 'put')
      SELECT seq AS candidate, CASE WHEN pin IS NOT NULL THEN (SELECT phash FROM p WHERE pseq = pin) ELSE {_BEST.format(c='target_hash', v='')} END AS base_hash,
        CASE WHEN pin IS NOT NULL THEN 'pin' WHEN {_BEST.format(c='seq', v='')} IS NOT NULL THEN 'library' END AS base_from FROM s"""),
    "accept_with_pins": (accept_with_pins, f"""WITH {D.FINDINGS_SQL}, p AS (SELECT package_id, row_number() OVER (ORDER BY package_id) + 999 AS seq FROM (SELECT DISTINCT package_id FROM findings)), c AS (SELECT package_id, kind, count(*) AS n FROM findings WHERE file = 'src/main.py' GROUP BY ALL)
      SELECT package_id AS name, seq, 'accepted' AS status, '2024-01-01T00:00:00+00:00' AS baselined_at, coalesce(string_agg(kind || '=' || n, ',' ORDER BY kind), '') AS pinned FROM p LEFT JOIN c USING (package_id) GROUP BY ALL"""),
    "refresh_outcomes": (refresh_outcomes, _I + _REFRESH + " SELECT key, spec, explicit, old_score, CASE WHEN outcome = 'refreshed' THEN m + 1 END AS new_score, outcome, error, outcome = 'refreshed' AS written FROM o"),
    "refresh_totals": (refresh_totals, _I + _REFRESH + " SELECT count(*) FILTER (outcome = 'refreshed') AS refreshed, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'refreshed') AS written FROM o"),
    "memory_forget": (memory_forget, """WITH m AS (SELECT doc_id AS seq, source, CASE WHEN doc_id % 31 = 5 AND doc_id % 2 = 0 THEN NULL ELSE 'v' || (doc_id % 7 + 1) END AS version, doc_id % 31 = 5 AS gone, CASE WHEN doc_id % 11 <> 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS approved_at FROM documents)
      SELECT seq, source, version, approved_at FROM m a WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM m b WHERE b.gone AND b.source = a.source AND b.seq >= a.seq AND (b.version IS NULL OR b.version = a.version))"""),
    "json_rows": (json_rows, """SELECT '{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END || '}' AS value FROM nation"""),
    "text_rows": (text_rows, "SELECT rtrim(rpad(CAST(n_nationkey AS VARCHAR), 4, ' ') || '  ' || CASE WHEN length(n_name) < 10 THEN rpad(n_name, 10, ' ') ELSE n_name END || '  ' || rpad(CASE WHEN n_regionkey = 0 THEN '-' ELSE CAST(n_regionkey AS VARCHAR) END, 8, ' ')) AS value FROM nation"),
}
