"""The append-only journal of audits and everything that is read from it.

A row is (seq, op, ecosystem, name, version, target_hash, audited_at, profile, status, score, role_typical_share, …);
``op`` is put or forget. "Replace and move to the end" is the latest seq of each target_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .scratch import numbered

PACKAGE = ["ecosystem", "name"]


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the largest seq of each key: one aggregate with partial maxima, no window over a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")


def index(journal: DataFrame) -> DataFrame:
    """The latest row of each (ecosystem, name, target_hash) that wasn't forgotten since; a forget row names a version."""
    puts = journal.where("op = 'put'")
    forgets = journal.where("op = 'forget'").groupBy(*PACKAGE, "version").agg(F.max("seq").alias("_gone"))
    live = puts.join(forgets, [*PACKAGE, "version"], "left").where("_gone IS NULL OR seq > _gone").drop("_gone")
    return _latest(live, [*PACKAGE, "target_hash"])


def accepted(rows: DataFrame) -> DataFrame:
    """Rows that count as accepted; a null status is of a time before statuses, and does."""
    return rows.where(F.coalesce("status", F.lit("accepted")) == "accepted")


def latest_known_good(rows: DataFrame) -> DataFrame:
    return _latest(accepted(rows), PACKAGE)


def accepted_for_version(rows: DataFrame) -> DataFrame:
    return _latest(accepted(rows), [*PACKAGE, "version"])


def latest_entry(rows: DataFrame, with_version: bool = False) -> DataFrame:
    """The last entry of any status."""
    return _latest(rows, [*PACKAGE, "version"] if with_version else PACKAGE)


def listed(rows: DataFrame, ecosystem: str | None = None, profile: str | None = None, status: str | None = None, name_like: str | None = None) -> DataFrame:
    """Filtered entries; a null profile is the plugin's, a null status accepted."""
    if ecosystem:
        rows = rows.where(F.col("ecosystem") == ecosystem)
    if profile:
        rows = rows.where(F.coalesce("profile", F.lit(C.DEFAULT_PROFILE)) == profile)
    if status:
        rows = rows.where(F.coalesce("status", F.lit("accepted")) == status)
    if name_like:
        rows = rows.where(F.lower("name").contains(name_like.lower()))
    return rows


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.coalesce("audited_at", F.lit("")).desc(), "seq")


def band(score: Column) -> Column:
    return F.when(score.isNull(), "unscored").when(score >= C.AUTO_ACCEPT_SCORE, "high").when(score >= C.MIN_SCORE, "mid").otherwise("low")


def counts_by(rows: DataFrame) -> DataFrame:
    """(dimension, value, n) for ecosystem, profile (null is unknown) and score band, in one pass of grouping sets."""
    facts = rows.select("ecosystem", F.coalesce("profile", F.lit("unknown")).alias("profile"), band(F.col("score")).alias("band"))
    sets = facts.groupingSets([[F.col("ecosystem")], [F.col("profile")], [F.col("band")]], F.col("ecosystem"), F.col("profile"), F.col("band")).agg(F.count(F.lit(1)).alias("n"), F.grouping("ecosystem").alias("g1"), F.grouping("profile").alias("g2"))
    return sets.select(F.when(F.col("g1") == 0, "ecosystem").when(F.col("g2") == 0, "profile").otherwise("band").alias("dimension"), F.coalesce("ecosystem", "profile", "band").alias("value"), "n")


def upper_median(rows: DataFrame, score: str = "score") -> DataFrame:
    """(median_score): element n // 2 of the sorted scores, from the counts of each score, so nothing is gathered but distinct scores."""
    counts = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("c"))
    sums = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(score).alias("s"), "c"))).alias("all"), F.sum("c").alias("n"))
    at = F.floor(F.col("n") / 2)
    step = lambda acc, x: F.struct((acc["seen"] + x["c"]).alias("seen"), F.when(acc["found"].isNull() & (acc["seen"] + x["c"] > at), x["s"]).otherwise(acc["found"]).alias("found"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(rows.schema[score].dataType).alias("found"))
    return sums.select(F.aggregate("all", start, step)["found"].alias("median_score"))


def stats(rows: DataFrame) -> DataFrame:
    """One row: total, mean_score, median_score (upper), the four bands, oldest and newest by the time's text."""
    b = band(F.col("score"))
    at = F.when(F.coalesce("audited_at", F.lit("")) != "", F.struct("audited_at", "seq"))
    one = rows.agg(
        F.count(F.lit(1)).alias("total"), F.avg("score").alias("mean_score"),
        *[F.count_if(b == name).alias(name) for name in ("high", "mid", "low", "unscored")],
        F.min(at)["seq"].alias("oldest_seq"), F.max(at)["seq"].alias("newest_seq"),
    )
    return one.join(upper_median(rows), F.lit(True), "left")  # one row with one row


def profile_means(rows: DataFrame) -> DataFrame:
    """(profile, mean_score, n): means to one place, a tie to the even digit."""
    return rows.where("score IS NOT NULL").groupBy(F.coalesce("profile", F.lit("unknown")).alias("profile")).agg(F.bround(F.avg("score"), 1).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def blocked_review(rows: DataFrame) -> DataFrame:
    """Blocked entries with their rank: role-typical first, then suspicious, each by falling share, then seq."""
    rank = F.when(F.col("status") == "blocked-role-typical", 1).otherwise(2)
    out = rows.where(F.col("status").isin("blocked-role-typical", "blocked-suspicious")).withColumn("group_rank", rank)
    return out.withColumn("share", F.coalesce("role_typical_share", F.lit(0.0))).orderBy("group_rank", F.desc("share"), "seq")


def prior_blocked(rows: DataFrame, most: int = 5) -> DataFrame:
    """(ecosystem, name, n, prior): how often a package was blocked, and the ``most`` of largest share as text.

    A package keeps ``most`` rows while partial results are merged, not all of its rows.
    """
    from pyspark.sql import Window as W

    blocked = rows.where(F.coalesce("status", F.lit("accepted")) != "accepted").withColumn("share", F.coalesce("role_typical_share", F.lit(0.0)))
    total = blocked.groupBy(*PACKAGE).agg(F.count(F.lit(1)).alias("n"))
    top = blocked.withColumn("rank", F.row_number().over(W.partitionBy(*PACKAGE).orderBy(F.desc("share"), "seq"))).where(F.col("rank") <= most)
    said = F.format_string("%s (%s, share=%s%%)", F.coalesce("version", F.lit("?")), "status", F.bround(F.col("share") * 100, 0).cast("int").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))), lambda x: x["said"]), ", ")
    return total.join(top.groupBy(*PACKAGE).agg(text.alias("prior")), PACKAGE)


def integrity(index_rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(ecosystem, name, target_hash, problem): index rows without a report, and reports without an index row."""
    keys = [*PACKAGE, "target_hash"]
    a, b = index_rows.select(*keys).distinct().withColumn("_a", F.lit(1)), reports.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, keys, "full_outer").where("_a IS NULL OR _b IS NULL").select(*keys, F.when(F.col("_b").isNull(), "missing").otherwise("orphan").alias("problem"))


def stamp(reports: DataFrame, first_seq: int, now: str, refresh: bool = False, schema_version: int = 1) -> DataFrame:
    """Rows to append for ``reports``: schema version, baselined_at where it is missing, refreshed_at on a refresh, seq in the order of the hashes."""
    if "baselined_at" not in reports.columns:
        reports = reports.withColumn("baselined_at", F.lit(None).cast("string"))
    out = reports.withColumns({"op": F.lit("put"), "schema_version": F.lit(schema_version), "baselined_at": F.coalesce("baselined_at", F.lit(now)), "refreshed_at": F.lit(now if refresh else None).cast("string")})
    return numbered(out, ["ecosystem", "name", "version", "target_hash"], "seq", first_seq)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("ecosystem").parquet(path)


def promote(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """(ecosystem, name, version, exit_code, action): what promoting each spec does. ``specs`` may lack a version."""
    found = latest_entry(rows, with_version=True).select(*PACKAGE, "version", "seq", "status")
    out = specs.join(found, [*PACKAGE, "version"], "left")
    action = F.when(F.col("version").isNull(), "no-version").when(F.col("seq").isNull(), "missing").when(F.coalesce("status", F.lit("accepted")) == "accepted", "no-op").otherwise("promote")
    return out.withColumn("action", action).withColumn("exit_code", F.when(F.col("action") == "no-version", 2).when(F.col("action") == "missing", 1).otherwise(0)).drop("seq", "status")


def promoted(rows: DataFrame, specs: DataFrame, first_seq: int, now: str, counts: DataFrame | None = None) -> DataFrame:
    """The rows to append that make the last entries of ``specs`` (ecosystem, name, version) accepted, where :func:`promote` says so.

    An entry keeps all that it has but its status, and is stamped as refreshed. With ``counts`` (ecosystem, name, version, kind, n) it pins them.
    """
    wanted = promote(rows, specs).where("action = 'promote'").select(*PACKAGE, "version").distinct()
    out = latest_entry(rows, with_version=True).join(wanted, [*PACKAGE, "version"], "left_semi").withColumn("status", F.lit("accepted"))
    if counts is not None:
        pinned = counts.groupBy(*PACKAGE, "version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.col("n").cast("int"))))).alias("expected_surface_counts"))
        out = out.drop("expected_surface_counts").join(pinned, [*PACKAGE, "version"], "left")
    return stamp(out.drop("seq", "op"), first_seq, now, refresh=True)


def pins(rows: DataFrame) -> DataFrame:
    """Project pins: rows of (project, seq, name, target_hash, …); a pin replaces earlier ones with its name or its hash."""
    later = rows.select(F.col("project").alias("p"), F.col("name").alias("n"), F.col("target_hash").alias("h"), F.col("seq").alias("s"))
    by_name = rows.join(later, (F.col("project") == F.col("p")) & (F.col("name") == F.col("n")) & (F.col("s") > F.col("seq")), "left_anti")
    return by_name.join(later, (F.col("project") == F.col("p")) & (F.col("target_hash") == F.col("h")) & (F.col("s") > F.col("seq")), "left_anti")
