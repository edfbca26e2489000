"""Self-test of a library: one row a check, in a fixed order. All checks read tables once, and aggregate before they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import journal


def _row(df: DataFrame, n: int, name: str, status, detail) -> DataFrame:
    return df.select(F.lit(n).alias("ordinal"), F.lit(name).alias("name"), status.alias("status"), detail.alias("detail"))


def checks(index_rows: DataFrame, reports: DataFrame, schema_version: int = 1) -> DataFrame:
    """(ordinal, name, status, detail) for the library's root, index, schema and profiles.

    ``index_rows`` and ``reports`` are of the journal; ``reports`` has schema_version. The index check names the first three problems.
    """
    mix = index_rows.groupBy(F.coalesce("profile", F.lit("<unset>")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    mix = mix.agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    said = F.array_join(F.transform("all", lambda x: F.concat(x["p"], F.lit("="), x["n"].cast("string"))), ", ")
    # the number of entries and the profiles are of the same rows: two checks of one aggregate
    both = F.array(
        F.struct(F.lit(1).alias("ordinal"), F.lit("library").alias("name"), F.when(F.col("n") > 0, "ok").otherwise("warn").alias("status"), F.format_string("%d entries", "n").alias("detail")),
        F.struct(F.lit(4).alias("ordinal"), F.lit("profiles").alias("name"), F.when(F.exists("all", lambda x: x["p"] == "<unset>"), "warn").otherwise("ok").alias("status"), said.alias("detail")),
    )
    library = mix.select(F.explode(both).alias("c")).select("c.*")
    bad = journal.integrity(index_rows, reports)
    # the three first of each problem come from partial results of three rows, not from all problems
    label = F.concat_ws("/", "ecosystem", "name", "target_hash")
    first = bad.groupBy("problem", F.pmod(F.xxhash64("target_hash"), F.lit(64)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set(label)), 1, 3).alias("some"))
    first = first.groupBy("problem").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, 3).alias("some"))
    of = lambda problem, c, none: F.coalesce(F.max(F.when(F.col("problem") == problem, F.col(c))), none)
    none = F.array().cast("array<string>")
    one = first.agg(of("missing", "n", F.lit(0)).alias("m"), of("missing", "some", none).alias("ms"), of("orphan", "n", F.lit(0)).alias("o"), of("orphan", "some", none).alias("os"))
    named = F.when(F.col("m") > 0, F.concat(F.lit(": "), F.array_join("ms", "; "))).when(F.col("o") > 0, F.concat(F.lit(": "), F.array_join("os", "; "))).otherwise("")
    index = _row(one, 2, "index", F.when(F.col("m") > 0, "fail").when(F.col("o") > 0, "warn").otherwise("ok"), F.concat(F.format_string("%d missing, %d orphan", "m", "o"), named))
    old = reports.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("schema_version", F.lit(0)) != schema_version).alias("s"))
    schema = _row(old, 3, "schema", F.when(F.col("s") > 0, "warn").otherwise("ok"), F.format_string("%d of %d stale", "s", "n"))
    return library.unionByName(index).unionByName(schema)


_SETTINGS = "struct<hooks:map<string,array<struct<matcher:string,hooks:array<struct<command:string>>>>>>"


def settings_check(settings: DataFrame, programs: DataFrame, event: str, matcher: str, suffix: str) -> DataFrame:
    """Two rows: whether the program is installed, and whether the agent's settings call it before shell commands.

    ``settings``: text of the settings file (no row: there is none). ``programs``: path and on_path of files that can be run.
    """
    place = programs.agg(F.min(F.when(F.col("on_path"), F.col("path"))).alias("path"))
    binary = _row(place, 5, "binary", F.when(F.col("path").isNull(), "fail").otherwise("ok"), F.coalesce("path", F.lit("not on the path")))
    one = settings.agg(F.max("text").alias("text")).withColumn("s", F.from_json("text", _SETTINGS))
    blocks = F.filter(F.try_element_at("s.hooks", F.lit(event)), lambda b: b["matcher"] == matcher)
    called = F.filter(F.transform(F.flatten(F.transform(blocks, lambda b: b["hooks"])), lambda h: h["command"]), lambda c: c.contains(suffix))
    key = F.lit(1).alias("one")
    one = one.select(key, "text", "s", blocks.alias("blocks"), F.get(called, F.lit(0)).alias("command")).join(place.select(key, "path"), "one")
    head = F.regexp_extract("command", r"^\s*(\S+)", 1)
    known = one.withColumn("head", head).join(programs.select(F.col("path").alias("head"), F.lit(True).alias("there")), "head", "left")
    status = F.when(F.col("text").isNull() | F.col("s").isNull() | (F.coalesce(F.size("blocks"), F.lit(0)) < 1) | F.col("command").isNull() | F.col("there").isNull(), "fail").when(F.col("path") != F.col("head"), "warn").otherwise("ok")
    detail = (
        F.when(F.col("text").isNull(), "no settings file").when(F.col("s").isNull(), "settings can't be read").when(F.coalesce(F.size("blocks"), F.lit(0)) < 1, F.lit(f"no {event}:{matcher} in the settings"))
        .when(F.col("command").isNull(), "the matcher has no hook of this program").when(F.col("there").isNull(), F.concat("head", F.lit(" does not exist"))).when(F.col("path") != F.col("head"), F.concat("head", F.lit(" is called, "), "path", F.lit(" is on the path"))).otherwise(F.col("command"))
    )
    return binary.unionByName(_row(known, 6, "hook", status, detail))


def cache_check(listing: DataFrame) -> DataFrame:
    """One row: what the cache holds. ``listing``: size."""
    n = listing.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return _row(n, 7, "cache", F.lit("ok"), F.when(F.col("n") == 0, "empty").otherwise(F.format_string("%d files, %.1f MiB", F.col("n"), F.col("bytes") / 1048576)))


def report(rows: DataFrame) -> DataFrame:
    """One row: ok, warn, fail, healthy."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.agg(count("ok"), count("warn"), count("fail")).withColumn("healthy", F.col("fail") == 0)
