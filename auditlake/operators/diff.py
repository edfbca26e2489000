"""What a candidate has that its baseline hasn't, and the reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C


def signature(extra: Column, kind: Column, file: Column, line: Column, detail: Column) -> Column:
    """``kind:<named surface>``, or by place where the kind has no key or the key is empty. ``extra`` is a struct."""
    keys: dict[str, list[str]] = {}
    for k, key in C.SIGNATURE_KEYS.items():
        if key:
            keys.setdefault(key, []).append(k)
    named = F.lit(None).cast("string")
    for key, kinds in keys.items():
        named = F.when(kind.isin(kinds), F.nullif(extra[key], F.lit(""))).otherwise(named)
    place = F.concat_ws(":", file, line.cast("string"), detail)
    return F.concat_ws(":", kind, F.coalesce(named, place))


def signatures(findings: DataFrame, keys: tuple = ("package_id",)) -> DataFrame:
    """Of the findings with one signature the last. ``findings``: *keys, seq, kind, file, line, detail, extra."""
    signed = findings.withColumn("signature", signature(F.col("extra"), F.col("kind"), F.col("file"), F.col("line"), F.col("detail")))
    rest = [c for c in signed.columns if c not in (*keys, "kind", "signature")]
    return signed.groupBy(*keys, "kind", "signature").agg(F.max_by(F.struct(*rest), "seq").alias("f")).select(*keys, "kind", "signature", "f.*")


def new_surfaces(candidate: DataFrame, baseline: DataFrame, keys: tuple = ("package_id",)) -> DataFrame:
    """Signatures of ``candidate`` that ``baseline`` lacks; swap the two for what was removed."""
    return candidate.join(baseline.select(*keys, "kind", "signature"), [*keys, "kind", "signature"], "left_anti")


def summary(new: DataFrame, removed: DataFrame, reports: DataFrame, keys: tuple = ("package_id",)) -> DataFrame:
    """One row for each of ``reports`` (*keys, score_before, score_after, profile_before, profile_after)."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = reports.join(count(new, "n_new"), list(keys), "left").join(count(removed, "n_removed"), list(keys), "left").na.fill({"n_new": 0, "n_removed": 0})
    profile = lambda c: F.coalesce(c, F.lit(C.DEFAULT_PROFILE))
    changed = profile(F.col("profile_before")) != profile(F.col("profile_after"))
    return out.select(*keys, (F.col("score_after") - F.col("score_before")).alias("score_delta"), "n_new", "n_removed", changed.alias("profile_changed"), ((F.col("n_new") > 0) | changed).alias("has_drift"))


def first_of_each_kind(findings: DataFrame, most: int = 5, keys: tuple = ("package_id",)) -> DataFrame:
    """The first ``most`` findings of each kind, and on each row how many more there are."""
    per = W.partitionBy(*keys, "kind")
    ranked = findings.withColumn("rank", F.row_number().over(per.orderBy("seq"))).withColumn("more", F.greatest(F.count(F.lit(1)).over(per) - most, F.lit(0)))
    return ranked.where(F.col("rank") <= most)
