r"""Quality rules with thresholds of each language and source's own, from mergeable quantile sketches.

Base rules are fixed: too few words, or too many of them in repeated three-word windows. The others hold a document against
what is usual in its language and source: rates of symbols, repeated lines and repeated words and the length of words must lie
within fences around the quartiles (``FENCE`` spreads beyond them, a spread being at least the rule's ``least``).

A sketch is a table (group, rule, bin, n) of log-linear bins of whole numbers: values under 64 have a bin each, larger ones 32 bins a
power of two, so a quantile is at most 1/32 below the exact one. Sketches merge by adding up ``n``; those of sources
merge into those of languages, and these into one, which stand in where a group has too few documents. Bins are integers, so neither
the order of rows nor a lost task changes a threshold.

Everything is DataFrame functions. Repeated windows are found inside a row: window hashes, their positions in the low bits, are sorted as an
array of longs and each is held against its neighbours, so no window leaves its document. Only sketches shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import WHITE, materialize, table, text_of
from ._native import let

LEAST_WORDS, MOST_REPEATED = 50, 50
#: Fences lie so many spreads (third less first quartile) beyond the quartiles.
FENCE = 3
#: A group of fewer documents takes the thresholds of its language, a language of fewer those of all.
LEAST_DOCUMENTS = 30
#: So many groups at most are broadcast; a larger table is joined by its keys.
FEW_GROUPS = 20_000
#: Rule: (value in whole numbers, least spread, whether there is a lower fence).
RULES = {
    "word_length": ("100 * word_chars div n_words", 50, True),
    "symbols": ("1000 * n_symbols div n_words", 30, False),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 100, False),
    "repeats": ("1000 * n_repeat_words div n_words", 100, False),
}


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in ``words`` (an array of strings).

    Windows are told apart by 64-bit hashes. A window's hash with its low bits replaced by its position is a long that sorts fast; where
    two neighbours agree in the high bits but not in the whole hash, the row is computed again from sorted structs.
    """

    def covered(positions: Column) -> Column:
        steps = lambda p: F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
        return let(F.sort_array(positions), lambda p: F.aggregate(steps(p), F.lit(0).cast("long"), lambda a, x: a + x))

    def by_structs(full: Column) -> Column:
        pairs = F.sort_array(F.transform(full, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        again = lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return let(pairs, lambda s: covered(F.transform(again(s), lambda x: x["i"])))

    def of_windows(full: Column, mask: Column) -> Column:
        high = lambda x: x.bitwiseAND(mask)
        at = lambda x: x.bitwiseAND(F.bitwise_not(mask))
        whole = lambda x: F.get(full, at(x).cast("int"))
        packed = F.sort_array(F.transform(full, lambda x, i: high(x).bitwiseOR(i.cast("long"))))
        again = lambda s: F.filter(s, lambda x, j: (high(x) == high(F.get(s, j - 1))) | (high(x) == high(F.get(s, j + 1))))
        clash = lambda f: F.exists(F.transform(f, lambda x, j: (high(x) == high(F.get(f, j + 1))) & (whole(x) != whole(F.get(f, j + 1)))), lambda x: x)
        return let(packed, lambda s: let(again(s), lambda f: F.when(F.size(f) == 0, F.lit(0).cast("long")).when(clash(f), by_structs(full)).otherwise(covered(F.transform(f, at)))))

    def of_words(w: Column) -> Column:
        full = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        mask = F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(F.size(w))))
        return let(full, lambda f: let(mask, lambda m: of_windows(f, m)))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, of_words))


def measured(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(id, lang, source) of each row with the counts of its whole text; a null text has none."""
    text = text_of(text_column)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = df.select(
        F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(source_column).alias("source"),
        F.filter(F.split(text, WHITE), lambda w: w != "").alias("words"), lines.alias("lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    return split.select(
        "id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketch(counts: DataFrame, keys: tuple = ("lang", "source")) -> DataFrame:
    """(*keys, rule, bin, n): the sketches of every group and rule over :func:`measured` rows that pass the base rules."""
    values = F.array(*[F.struct(F.lit(rule).alias("rule"), F.expr(value).alias("v")) for rule, (value, _, _) in RULES.items()])
    each = counts.where(~base_failed()).select(*keys, F.explode(values).alias("e")).select(*keys, "e.rule", "e.v")
    low_bits = F.greatest(F.lit(0), F.length(F.bin("v")) - 6)
    binned = each.withColumn("bin", F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), low_bits), low_bits))
    return binned.groupBy(*keys, "rule", "bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: tuple = ("lang", "source")) -> DataFrame:
    """Sketches of equal ``keys`` as one; of a union of tables, or of groups that become a larger one."""
    return sketches.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame, keys: tuple = ("lang", "source"), fence: int = FENCE) -> DataFrame:
    """(*keys, documents, fences): for each rule the lowest and highest value that its group's quartiles allow."""
    bins = W.partitionBy(*keys, "rule")  # as many rows as a sketch has bins
    summed = sketches.withColumns({"below": F.sum("n").over(bins.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("n").over(bins)})
    quartile = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("all"), F.col("bin"))).alias(f"q{k}")
    q = summed.groupBy(*keys, "rule").agg(quartile(1), quartile(3), F.max("all").alias("documents"))
    least = F.element_at(F.create_map(*[F.lit(x) for rule, (_, spread, _) in RULES.items() for x in (rule, spread)]), F.col("rule"))
    spread = fence * F.greatest(F.col("q3") - F.col("q1"), least)
    low = F.when(F.col("rule").isin(*[rule for rule, (_, _, lower) in RULES.items() if lower]), F.col("q1") - spread)
    fences = q.select(*keys, "rule", "documents", F.struct(low.alias("low"), (F.col("q3") + spread).alias("high")).alias("f"))
    return fences.groupBy(*keys).agg(F.max("documents").alias("documents"), F.struct(*[F.max(F.when(F.col("rule") == rule, F.col("f"))).alias(rule) for rule in RULES]).alias("fences"))


def judged(counts: DataFrame, sketches: DataFrame, least_documents: int = LEAST_DOCUMENTS, fence: int = FENCE) -> DataFrame:
    """``counts`` with base_failed, kept and reason (the rules that a row breaks, else empty) under the thresholds of ``sketches``.

    Groups of fewer than ``least_documents`` take the thresholds of their language, these those of all. A null language or source is one
    like others. Rows of a group that ``sketches`` does not have take the next level's; without any sketch only the base rules hold.
    """
    own = thresholds(sketches, fence=fence)
    langs = thresholds(merge(sketches, ("lang",)), ("lang",), fence)
    everything = thresholds(merge(sketches.withColumn("all_", F.lit(0)), ("all_",)), ("all_",), fence)
    groups = sketches.select("lang", "source").distinct()
    level = lambda t, name, *keys: t.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct("documents", "fences").alias(name))
    fits = groups.join(level(langs, "of_lang", "lang"), F.col("lang").eqNullSafe(F.col("of_lang_lang")), "left")
    fits = fits.join(level(own, "own", "lang", "source"), F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")), "left")
    enough = lambda name: F.col(f"{name}.documents") >= least_documents
    fits = fits.select(F.col("lang").alias("fit_lang"), F.col("source").alias("fit_source"), F.when(enough("own"), F.col("own.fences")).when(enough("of_lang"), F.col("of_lang.fences")).alias("fit"))
    fits = materialize(fits, "fences")
    # the fences of a language for sources without a sketch, and those of all: one row
    langs = level(langs.where(F.col("documents") >= least_documents), "of_lang", "lang")
    near = (lambda t: F.broadcast(t)) if fits.count() <= FEW_GROUPS else (lambda t: t.hint("merge"))
    rows = counts.join(near(fits), F.col("lang").eqNullSafe(F.col("fit_lang")) & F.col("source").eqNullSafe(F.col("fit_source")), "left")
    rows = rows.join(near(langs), F.col("lang").eqNullSafe(F.col("of_lang_lang")), "left")
    last = everything.select("fences").first()
    kind = everything.schema["fences"].dataType
    rows = rows.withColumn("fit", F.coalesce("fit", "of_lang.fences", F.from_json(F.lit(_as_json(last)), kind)))
    failed = {"base": base_failed()}
    for rule, (value, _, lower) in RULES.items():
        v = F.when(F.col("n_words") > 0, F.expr(value))
        failed[rule] = (v > F.col(f"fit.{rule}.high")) | ((v < F.col(f"fit.{rule}.low")) if lower else F.lit(False))
    reason = F.concat_ws(",", *[F.when(broken, F.lit(rule)) for rule, broken in failed.items()])
    out = rows.withColumns({"base_failed": base_failed(), "reason": reason}).withColumn("kept", F.col("reason") == "")
    return out.select(*counts.columns, "base_failed", "kept", "reason")


def _as_json(row) -> str | None:
    return json.dumps(row.fences.asDict(recursive=True)) if row else None


def filter_quality(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """One row for each row of ``df``: id, the counts of its whole text, base_failed, kept, reason.

    Null texts count as empty and fail the base rules; repeated rows are judged alike and each counts in the sketches. An empty table gives an empty
    result. Words are runs of ``[^\\x20\\x09-\\x0D]``. Other columns are not read. A very long text is one row's arrays.
    """
    counts = materialize(measured(df, id_column, text_column, lang_column, source_column), "measured")
    found = judged(counts, materialize(sketch(counts), "sketches"))
    return found.select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, by :func:`filter_quality` at its defaults. Null texts fail the base rules; repeated rows are judged alike."""
    return filter_quality(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols
  FROM documents
), windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
valued AS (
  SELECT doc_id, lang, source, base_failed, unnest([
    {'rule': 'word_length', 'least': 50, 'v': 100 * word_chars // n_words}, {'rule': 'symbols', 'least': 30, 'v': 1000 * n_symbols // n_words},
    {'rule': 'dup_lines', 'least': 100, 'v': 1000 * n_dup_lines // n_lines}, {'rule': 'repeats', 'least': 100, 'v': 1000 * n_repeat_words // n_words}], recursive := true)
  FROM judged WHERE n_words > 0
), binned AS (
  SELECT lang, source, rule, least, count(*) AS n, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS b
  FROM valued WHERE NOT base_failed GROUP BY lang, source, rule, least, b
), levels AS (
  SELECT 1 AS level, lang, source, rule, least, b, n FROM binned
  UNION ALL SELECT 2, lang, NULL, rule, least, b, sum(n) FROM binned GROUP BY lang, rule, least, b
  UNION ALL SELECT 3, NULL, NULL, rule, least, b, sum(n) FROM binned GROUP BY rule, least, b
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY b) AS below, sum(n) OVER (PARTITION BY level, lang, source, rule) AS documents FROM levels
), quartiles AS (
  SELECT level, lang, source, rule, least, documents, min(b) FILTER (4 * below >= documents) AS q1, min(b) FILTER (4 * below >= 3 * documents) AS q3
  FROM summed GROUP BY ALL
), fences AS (
  SELECT level, lang, source, rule, CASE WHEN rule = 'word_length' THEN q1 - 3 * greatest(q3 - q1, least) END AS low, q3 + 3 * greatest(q3 - q1, least) AS high
  FROM quartiles WHERE documents >= 30 OR level = 3
), broken AS (
  SELECT v.doc_id, v.rule
  FROM valued v JOIN fences f ON v.rule = f.rule AND (f.level = 3 OR f.lang IS NOT DISTINCT FROM v.lang) AND (f.level > 1 OR f.source IS NOT DISTINCT FROM v.source)
  GROUP BY v.doc_id, v.rule, v.v HAVING v.v > arg_min(f.high, f.level) OR v.v < arg_min_null(f.low, f.level)
), rules AS (SELECT doc_id, list(rule) AS rules FROM broken GROUP BY doc_id),
reasons AS (
  SELECT j.*, concat_ws(',', CASE WHEN base_failed THEN 'base' END, CASE WHEN list_contains(rules, 'word_length') THEN 'word_length' END, CASE WHEN list_contains(rules, 'symbols') THEN 'symbols' END,
         CASE WHEN list_contains(rules, 'dup_lines') THEN 'dup_lines' END, CASE WHEN list_contains(rules, 'repeats') THEN 'repeats' END) AS reason
  FROM judged j LEFT JOIN rules USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason = '' AS kept, reason FROM reasons
"""
