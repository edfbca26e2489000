"""The library of audits as tables: scans of its files, lookups, accepting, refreshing, sinks and settings."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from . import journal
from .scratch import cut

_ENTRIES = "struct<name:string,entries:array<struct<version:string,target_hash:string,audited_at:string,score:int>>>"
_REPORT = "struct<profile:string,profile_reason:string,status:string>"


def index_scan(files: DataFrame, ecosystem: str | None = None) -> DataFrame:
    """One row for each entry of the library's index files, in the order of (ecosystem, name, ordinal).

    ``files``: rel, text; rel is ``<ecosystem>/<name>/_index.json``, or ``<ecosystem>/<name>/<version>/<target_hash>.json`` of a report, which
    gives an entry its profile and status. A missing status is accepted, as in entries of a time before statuses. What is no JSON has no entries.
    """
    parts = F.split("rel", "/")
    own = files.select(F.element_at(parts, 1).alias("ecosystem"), "rel", "text")
    # the store of trusted texts is no ecosystem, but can be asked for like one
    own = own.where(F.col("ecosystem") == ecosystem) if ecosystem else own.where("ecosystem != 'memory'")
    name = F.regexp_extract("rel", r"^[^/]+/(.+)/_index\.json$", 1)
    index = own.where("rel LIKE '%/_index.json'").select("ecosystem", name.alias("folder"), F.from_json("text", _ENTRIES).alias("i"))
    rows = index.select("ecosystem", "folder", F.coalesce("i.name", "folder").alias("name"), F.posexplode("i.entries").alias("ordinal", "e")).select("ecosystem", "folder", "name", "ordinal", "e.*")
    rows = rows.withColumn("rel", F.concat_ws("/", "ecosystem", "folder", F.coalesce("version", F.lit("unversioned")), F.concat("target_hash", F.lit(".json"))))
    reports = own.where("rel NOT LIKE '%/_index.json'").select("rel", F.from_json("text", _REPORT).alias("r")).select("rel", "r.*")
    out = rows.join(reports, "rel", "left").withColumn("status", F.coalesce("status", F.lit("accepted")))
    return out.select("ecosystem", "name", "ordinal", "version", "target_hash", "audited_at", "score", "profile", "profile_reason", "status").orderBy("ecosystem", "name", "ordinal")


def size(listing: DataFrame) -> DataFrame:
    """(ecosystem, files, bytes) of a listing (rel, size) of the library, and one row for all of it with a null ecosystem."""
    return listing.select(F.regexp_extract("rel", "^([^/]+)/", 1).alias("ecosystem"), "size").rollup("ecosystem").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def known_hashes(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """``candidates`` (ecosystem, name, target_hash, …) with library: the entry of that very content, or null."""
    keys = ["ecosystem", "name", "target_hash"]
    rest = [c for c in rows.columns if c not in keys]
    return candidates.join(rows.select(*keys, F.struct(*rest).alias("library")), keys, "left")


def pinned_profiles(specs: DataFrame, rows: DataFrame) -> DataFrame:
    """``specs`` (ecosystem, name, version) with pinned: the profile under which their baseline was accepted, or null.

    The baseline is the newest accepted entry of the version, else of any version.
    """
    good = journal.accepted(rows)
    newest = lambda keys, out: good.groupBy(*keys).agg(F.max_by(F.struct("profile"), "seq").alias(out))
    found = specs.join(newest(["ecosystem", "name", "version"], "_same"), ["ecosystem", "name", "version"], "left").join(newest(["ecosystem", "name"], "_any"), ["ecosystem", "name"], "left")
    return found.withColumn("pinned", F.coalesce("_same", "_any")["profile"]).drop("_same", "_any")


def resolved(candidates: DataFrame, pins: DataFrame, rows: DataFrame) -> DataFrame:
    """``candidates`` (project, name, target_hash, ecosystem, …) with base: what they are compared with, and base_from.

    First the project's pin, the earliest that has the candidate's hash or name; else the library's newest accepted entry of the name; else null.
    The earliest pin of each name and of each hash is found first, so a candidate meets at most two however many pins its project has.
    """
    first = lambda column: pins.groupBy("project", column).agg(F.min_by(F.struct("seq", F.struct(*pins.columns).alias("pin")), "seq").alias(f"_by_{column}"))
    found = candidates.join(first("name"), ["project", "name"], "left").join(first("target_hash"), ["project", "target_hash"], "left")
    name, hash_ = F.col("_by_name"), F.col("_by_target_hash")
    found = found.withColumn("_pin", F.when(hash_.isNull() | (name["seq"] <= hash_["seq"]), name["pin"]).otherwise(hash_["pin"])).drop("_by_name", "_by_target_hash")
    good = journal.latest_known_good(rows)
    good = good.select("ecosystem", "name", F.struct(*[c for c in good.columns if c not in ("ecosystem", "name")]).alias("_good"))
    out = found.join(good, ["ecosystem", "name"], "left")
    hash_ = F.coalesce("_pin.target_hash", "_good.target_hash")
    return out.withColumns({"base_hash": hash_, "base_from": F.when(F.col("_pin").isNotNull(), "pin").when(F.col("_good").isNotNull(), "library")}).drop("_pin", "_good")


def accept(reports: DataFrame, counts: DataFrame | None, first_seq: int, now: str) -> DataFrame:
    """Journal rows that accept ``reports`` (ecosystem, name, version, target_hash, …) as baselines.

    With ``counts`` (package_id, kind, n; reports then have package_id) each row pins them in expected_surface_counts, a map that is empty for a
    package without findings.
    """
    out = reports.withColumn("status", F.lit("accepted"))
    if counts is not None:
        pinned = counts.groupBy("package_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.col("n").cast("int"))))).alias("expected_surface_counts"))
        out = out.join(pinned, "package_id", "left").withColumn("expected_surface_counts", F.coalesce("expected_surface_counts", F.create_map().cast("map<string,int>")))
    return journal.stamp(out, first_seq, now)


def closure_to_accept(accepted: DataFrame, reports: DataFrame, first_seq: int, now: str) -> DataFrame:
    """Journal rows of the pending packages of closures that aren't refused; each package once. ``accepted``: root, refused, pending; ``reports``: node, …."""
    pending = accepted.where("NOT refused").select(F.explode("pending").alias("node")).distinct()
    return accept(reports.join(pending, "node", "left_semi").drop("node"), None, first_seq, now)


def to_refresh(rows: DataFrame, ecosystem: str | None = None, name_like: str | None = None, status: str | None = None, redetect: bool = False) -> DataFrame:
    """What a refresh audits again: (ecosystem, name, version, spec, old_score, explicit), explicit being the stored profile unless it is to be found anew."""
    chosen = journal.listed(rows, ecosystem=ecosystem, status=status, name_like=name_like)
    profile = F.lit(None).cast("string") if redetect else F.col("profile")
    return chosen.select("ecosystem", "name", "version", "target_hash", "status", N.format_spec(F.col("name"), F.col("version"), F.col("ecosystem")).alias("spec"), F.col("score").alias("old_score"), profile.alias("explicit"))


def refreshed(wanted: DataFrame, audited: DataFrame, dry_run: bool = False) -> DataFrame:
    """``wanted`` with outcome (refreshed or error), new_score and whether it is to be written.

    ``audited``: ecosystem, name, version, new_score, error; a package that has none there, or one with an error, is an error.
    """
    out = wanted.join(audited.select("ecosystem", "name", "version", "new_score", "error", F.lit(True).alias("_found")), ["ecosystem", "name", "version"], "left")
    failed = F.col("_found").isNull() | F.col("error").isNotNull()
    out = out.withColumn("outcome", F.when(failed, "error").otherwise("refreshed")).withColumn("error", F.when(F.col("_found").isNull(), "not audited").otherwise(F.col("error")))
    return out.withColumn("new_score", F.when(~failed, F.col("new_score"))).withColumn("written", ~failed & F.lit(not dry_run)).drop("_found")


def refresh(wanted: DataFrame, packages: DataFrame, files: DataFrame, first_seq: int, now: str, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rows) of auditing again what :func:`to_refresh` chose: each at the profile that it asks for, or at one that is found anew.

    ``packages``: package_id, ecosystem, name, version of what ``files`` holds; an entry without files is an error. rows are to be appended to the
    journal: entries keep their status, and have the new hash, score and profile.
    """
    from ..operators import audit

    own = packages.groupBy("ecosystem", "name", "version").agg(F.min("package_id").alias("package_id"))
    asked = wanted.groupBy("ecosystem", "name", "version").agg(F.max("explicit").alias("explicit"))
    chosen = cut(asked.join(own, ["ecosystem", "name", "version"]))
    given = chosen.select("package_id", "explicit", F.lit(None).cast("string").alias("pinned"))
    reports, _ = audit.report(files.join(chosen.select("package_id"), "package_id", "left_semi"), given, names)
    fresh = cut(chosen.drop("explicit").join(reports.drop("ecosystem", "name", "version"), "package_id"))
    outcomes = refreshed(wanted, fresh.select("ecosystem", "name", "version", F.col("final_score").alias("new_score"), F.lit(None).cast("string").alias("error")))
    kept = outcomes.where("written").select("ecosystem", "name", "version", "status").distinct()
    rows = kept.join(fresh.select("ecosystem", "name", "version", "target_hash", "profile", "profile_reason", F.col("final_score").alias("score"), "role_typical_share"), ["ecosystem", "name", "version"])
    return outcomes, journal.stamp(rows.withColumn("audited_at", F.lit(now)), first_seq, now, refresh=True)


def refresh_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if(F.col("outcome") == "refreshed").alias("refreshed"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if("written").alias("written"))


def memory_view(rows: DataFrame) -> DataFrame:
    """Records of trusted texts that weren't forgotten since: a forget row names a source and a version (null: all of its versions)."""
    puts, gone = rows.where("op = 'put'"), rows.where("op = 'forget'")
    one = gone.where("version IS NOT NULL").groupBy("source", "version").agg(F.max("seq").alias("_one"))
    all_ = gone.where("version IS NULL").groupBy("source").agg(F.max("seq").alias("_all"))
    live = puts.join(one, ["source", "version"], "left").join(all_, "source", "left")
    return live.where("(_one IS NULL OR seq > _one) AND (_all IS NULL OR seq > _all)").drop("_one", "_all")


def memory_list(rows: DataFrame, source: str | None = None) -> DataFrame:
    """Newest first; a record without a time is the oldest."""
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return rows.orderBy(F.coalesce("approved_at", F.lit("")).desc(), "seq")


def content_diff(pairs: DataFrame, prior: str = "prior", candidate: str = "candidate", version: str = "version") -> DataFrame:
    """``pairs`` with diff: the unified difference of two texts, or null where there is no prior text. Texts are compared pair by pair."""

    @F.pandas_udf("string")
    def unified(a: pd.Series, b: pd.Series, v: pd.Series) -> pd.Series:
        lines = lambda x: (x or "").splitlines()
        return pd.Series([None if x is None else "\n".join(difflib.unified_diff(lines(x), lines(y), f"approved {w}", "candidate", lineterm="")) for x, y, w in zip(a, b, v)], dtype=object)

    return pairs.withColumn("diff", unified(prior, candidate, version))


def as_json(df: DataFrame, indent: bool = False) -> DataFrame:
    """(value): each row as JSON, fields in the order of the columns, nulls included; with ``indent`` over several lines."""
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if indent else {})
    return df.select(F.to_json(F.struct(*df.columns), options).alias("value"))


def as_text(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(value): the columns of ``widths`` as text, each filled up to its width (a longer one keeps its length), two spaces between."""
    cell = lambda c, n: F.when(F.length(said(c)) < n, F.rpad(said(c), n, " ")).otherwise(said(c))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return df.select(F.rtrim(F.concat_ws("  ", *[cell(c, n) for c, n in widths.items()])).alias("value"))


