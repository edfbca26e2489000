"""Findings to deductions to a package's locality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import dims, files


def dedupe_hosts(findings: DataFrame) -> DataFrame:
    """Of hardcoded_host findings the first of each host of a package, in the order of (file, line, seq); others pass.

    Needs package_id, seq, kind, file, line and host; a missing host is the host "". Runs before contexts are looked at. Only hosts
    shuffle, as partial minima.
    """
    rest = [c for c in findings.columns if c != "package_id"]
    hosts = findings.where("kind = 'hardcoded_host'").groupBy("package_id", F.coalesce("host", F.lit("")).alias("_host"))
    first = hosts.agg(F.min_by(F.struct(*rest), F.struct("file", "line", "seq")).alias("f")).select("package_id", "f.*")
    return findings.where("kind != 'hardcoded_host'").unionByName(first)


def runtime_findings(findings: DataFrame) -> DataFrame:
    """Findings in runtime files; a file that couldn't be read counts wherever it is."""
    return findings.where((F.col("kind") == "unauditable_file") | (files.context(F.col("file")) == "runtime"))


def surface_counts(findings: DataFrame, keys: tuple = ("package_id",)) -> DataFrame:
    return findings.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))


def _weighted(findings: DataFrame) -> DataFrame:
    """One row for each package, profile and kind, runtime or not, with its weights (null without any) and what they deduct.

    The counts shuffle as partial sums, the 325 weights are broadcast.
    """
    spark = findings.sparkSession
    known = F.when(F.col("profile").isin(C.PROFILES), F.col("profile")).otherwise(C.DEFAULT_PROFILE)
    runtime = (F.col("kind") == "unauditable_file") | (files.context(F.col("file")) == "runtime")
    counts = findings.select("package_id", known.alias("profile"), "kind", runtime.alias("runtime"), (F.col("shape") == C.ENCODED_SHAPE).alias("hidden"))
    counts = counts.groupBy("package_id", "profile", "kind").agg(F.count_if("runtime").alias("n"), F.count_if(F.col("runtime") & F.coalesce("hidden", F.lit(False))).alias("encoded"))
    rows = counts.join(F.broadcast(dims.weights(spark)), ["profile", "kind"], "left")
    plain = F.least(F.col("per_finding") * F.col("n"), F.col("cap"))
    split = F.least(F.least(F.col("per_finding") * F.col("encoded"), F.col("cap")) + F.least(F.col("dyn_per") * (F.col("n") - F.col("encoded")), F.col("dyn_cap")), F.col("cap"))
    weighs = (F.col("n") > 0) & (F.col("cap") > 0)
    return rows.withColumn("deducted", F.when(weighs, F.when(F.col("kind") == "obfuscation", split).otherwise(plain)).cast("long"))


def deductions(findings: DataFrame) -> DataFrame:
    """One row for each package and weighted kind: count, deducted, role_typical, encoded_count, dynamic_count.

    Needs package_id, profile, kind, file and shape. An unknown profile has the plugin's weights; kinds without a weight or with
    cap 0 are left out, as are findings out of runtime files.
    """
    hidden = F.col("kind") == "obfuscation"
    return _weighted(findings).where("deducted IS NOT NULL").select(
        "package_id", "profile", "kind", "n", "per_finding", "cap", "deducted", "role_typical",
        F.when(hidden, F.col("encoded")).alias("encoded_count"), F.when(hidden, F.col("n") - F.col("encoded")).alias("dynamic_count"),
        F.when(hidden, F.col("dyn_per")).alias("dynamic_per_finding"), F.when(hidden, F.col("dyn_cap")).alias("dynamic_cap"),
    )


def score(findings: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """One row a package: final_score, deducted, role_typical_deducted, role_typical_share (unrounded; 0.0 without deductions), critical.

    A package all of whose findings weigh nothing has 100. ``packages`` (package_id, profile) also names those without findings, which have 100.
    """
    sums = _weighted(findings).groupBy("package_id", "profile").agg(
        F.coalesce(F.sum("deducted"), F.lit(0)).alias("deducted"),
        F.coalesce(F.sum(F.when(F.col("role_typical"), F.col("deducted"))), F.lit(0)).alias("role_typical_deducted"),
        F.coalesce(F.bool_or(F.col("kind").isin(C.CRITICAL_KINDS) & (F.col("deducted") > 0)), F.lit(False)).alias("critical"),
    )
    if packages is not None:
        known = F.when(F.col("profile").isin(C.PROFILES), F.col("profile")).otherwise(C.DEFAULT_PROFILE)
        sums = packages.select("package_id", known.alias("profile")).distinct().join(sums, ["package_id", "profile"], "left").na.fill({"deducted": 0, "role_typical_deducted": 0, "critical": False})
    share = F.when(F.col("deducted") > 0, F.col("role_typical_deducted") / F.col("deducted")).otherwise(0.0)
    return sums.select("package_id", "profile", F.greatest(F.lit(0), 100 - F.col("deducted")).cast("int").alias("final_score"), "deducted", "role_typical_deducted", share.alias("role_typical_share"), "critical")


def rounded_share(typical: Column, deducted: Column) -> Column:
    """typical / deducted to three places in whole numbers, a tie to the even digit; 0.0 without deductions."""
    low = F.floor(typical * 1000 / F.greatest(deducted, F.lit(1)))
    over = 2 * (typical * 1000 - low * deducted)
    up = (over > deducted) | ((over == deducted) & (low % 2 == 1))
    return F.when(deducted > 0, (low + F.when(up, 1).otherwise(0)) / 1000.0).otherwise(0.0)


def blocked_status(critical: Column, share: Column) -> Column:
    return F.when(critical, "blocked-suspicious").when(share >= C.ROLE_TYPICAL_THRESHOLD, "blocked-role-typical").otherwise("blocked-suspicious")
