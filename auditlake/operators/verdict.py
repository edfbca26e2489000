"""From a score and a baseline to a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import names
from ..functions import text as T
from ..sources import settings
from .scoring import blocked_status


def novel_high_risk(new: DataFrame, counts: DataFrame, baselines: DataFrame, keys: tuple = ("package_id",)) -> DataFrame:
    """(*keys, novel): sorted high-risk kinds with a new surface.

    Where the baseline pins counts (``pinned``, a map that isn't empty) a kind is novel only if the candidate has
    more of it than pinned; a kind without a pin has 0. ``counts``: *keys, kind, n over all of the candidate's findings.
    """
    kinds = new.where(F.col("kind").isin(C.HIGH_RISK_KINDS)).select(*keys, "kind").distinct()
    out = kinds.join(counts, [*keys, "kind"], "left").join(baselines.select(*keys, "pinned"), list(keys), "left")
    pinned = F.coalesce(F.size("pinned") > 0, F.lit(False))
    over = F.coalesce("n", F.lit(0)) > F.coalesce(F.try_element_at("pinned", F.col("kind")), F.lit(0))
    return out.where(~pinned | over).groupBy(*keys).agg(F.array_sort(F.collect_set("kind")).alias("novel"))


def baseline_of(specs: DataFrame, journal_view: DataFrame) -> DataFrame:
    """Each spec (ecosystem, name, version) with its accepted baseline: the newest of its version, else the newest of any.

    ``journal_view`` holds the latest row of each target_hash (:func:`auditlake.sources.journal.index`).
    """
    accepted = journal_view.where(F.coalesce("status", F.lit("accepted")) == "accepted")
    rest = [c for c in accepted.columns if c not in ("ecosystem", "name")]
    newest = lambda keys: accepted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("b"))
    same = newest(["ecosystem", "name", "version"]).withColumnRenamed("b", "same")
    any_ = newest(["ecosystem", "name"]).withColumnRenamed("b", "any_")
    out = specs.join(same, ["ecosystem", "name", "version"], "left").join(any_, ["ecosystem", "name"], "left")
    return out.withColumn("baseline", F.coalesce("same", "any_")).drop("same", "any_")


def reasons_of(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons))


def verdicts(candidates: DataFrame, min_score: int | None = None, auto_score: int | None = None) -> DataFrame:
    """One verdict a candidate: status, reasons, write_status (what goes to the journal, or null). Scores that aren't given are those of :mod:`auditlake.sources.settings`.

    ``candidates``: ecosystem, name, version, target_hash, profile, score, critical, role_typical_share, accept_new,
    baseline (struct with status, target_hash, profile; null for a first encounter), novel (array), prior (text or null).
    """
    spark = candidates.sparkSession
    min_score = settings.min_score(spark) if min_score is None else min_score
    auto_score = settings.auto_accept_score(spark) if auto_score is None else auto_score
    score = F.coalesce("score", F.lit(0))
    low = score < min_score
    low_text = F.format_string(f"score %d below threshold {min_score}", score)
    first = F.col("baseline").isNull()
    blocked = blocked_status(F.coalesce("critical", F.lit(False)), F.coalesce("role_typical_share", F.lit(0.0)))
    accepted = F.coalesce("accept_new", F.lit(False)) | (score >= auto_score)
    profile = lambda c: F.coalesce(c, F.lit(C.DEFAULT_PROFILE))
    # only a literal "accepted" with the same hash forgives a low score
    forgiven = F.coalesce((F.col("baseline.status") == "accepted") & (F.col("baseline.target_hash") == F.col("target_hash")) & (F.col("target_hash") != ""), F.lit(False))
    novel = F.coalesce("novel", F.array().cast("array<string>"))
    changed = profile(F.col("baseline.profile")) != profile(F.col("profile"))
    again = reasons_of(
        F.when(low & ~forgiven, low_text),
        F.when(F.size(novel) > 0, F.concat(F.lit("novel high-risk surfaces vs. baseline: "), F.array_join(novel, ", "))),
        F.when(changed, F.concat(F.lit("profile changed: "), profile(F.col("baseline.profile")), F.lit(" -> "), profile(F.col("profile")))),
    )
    spec = names.format_spec(F.col("name"), F.col("version"), F.col("ecosystem"))
    opening = reasons_of(
        F.lit("no prior baseline in library"),
        F.when(F.col("prior").isNotNull(), F.concat(F.lit("prior blocked encounters for "), F.col("name"), F.lit(": "), F.col("prior"))),
        F.when(low, low_text),
        F.when(low, F.concat(F.lit("library-status: "), blocked, F.format_string(" (role_typical_share=%.2f)", F.coalesce("role_typical_share", F.lit(0.0))))),
        F.when(~low & ~accepted, F.concat(F.lit("first encounter: review and accept "), spec, F.lit(" to baseline it"))),
        F.when(~low & F.coalesce("accept_new", F.lit(False)), F.lit("pinned into library as new baseline")),
        F.when(~low & ~F.coalesce("accept_new", F.lit(False)) & accepted, F.format_string(f"auto-baselined (score %d >= {auto_score})", score)),
    )
    status = F.when(first, F.when(low, "low-score").when(accepted, "first-encounter-accepted").otherwise("first-encounter-needs-accept")).otherwise(F.when(F.size(again) == 0, "safe").otherwise("drift"))
    write = F.when(first & low, blocked).when(first & accepted, "accepted")
    out = candidates.withColumns({"status": status, "reasons": F.when(first, opening).otherwise(again), "write_status": write})
    is_blocked = ~F.col("status").isin("safe", "first-encounter-accepted")
    return out.withColumn("blocked", is_blocked).withColumn("summary", T.verdict_summary(is_blocked, spec, F.col("status"), F.col("reasons")))
