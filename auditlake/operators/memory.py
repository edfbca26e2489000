"""Scan and approval of trusted text blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from . import sweep


def severity(kind: Column) -> Column:
    return F.when(kind.isin(C.ADVERSE_KINDS), "adverse").otherwise("informational")


def blob_lines(blobs: DataFrame, keys: tuple, text: str = "blob") -> DataFrame:
    """(*keys, line, said, chars): the lines of each blob, with the length of the blob."""
    out = blobs.select(*keys, F.length(text).alias("chars"), F.posexplode(T.lines(F.col(text))).alias("pos", "said"))
    return out.select(*keys, (F.col("pos") + 1).alias("line"), "said", "chars")


def _signals() -> list[Column]:
    found = lambda kind, signal: lambda m: sweep.finding(F.lit(kind), T.strip(m), signal=F.lit(signal))
    return [F.transform(F.regexp_extract_all("said", T.unicode(p), 0), found(k, s)) for p, k, s in C.MEMORY_PATTERNS]


def _zero_width() -> Column:
    return F.when(F.rlike("said", F.lit(C.ZERO_WIDTH)), F.array(sweep.finding(F.lit("obfuscation"), F.lit("<zero-width / bidi-override chars>"), signal=F.lit("zero-width"))))


def _anomalies() -> Column:
    """Lines over their cap and, on its first line, a blob over its cap; needs ``said``, ``line`` and ``chars`` of the blob."""
    over = lambda what, n, cap, signal: sweep.finding(F.lit("obfuscation"), F.format_string(f"<{what} len=%d > cap {cap}>", n), signal=F.lit(signal))
    blob = F.when((F.col("line") == 1) & (F.col("chars") > C.MAX_BLOB_CHARS), over("blob", F.col("chars"), C.MAX_BLOB_CHARS, "oversized-blob"))
    line = F.when(F.length("said") > C.MAX_LINE_CHARS, over("line", F.length("said"), C.MAX_LINE_CHARS, "oversized-line"))
    return F.array_compact(F.array(blob, line))


def _found(lines: DataFrame, keys: tuple, arrays: list[Column]) -> DataFrame:
    return lines.select(*keys, "line", F.explode(sweep.gathered(arrays)).alias("f")).select(*keys, "line", "f.*")


def find_signals(lines: DataFrame, keys: tuple) -> DataFrame:
    """All line patterns in one pass over the lines; the detail is the match without white space around it."""
    return _found(lines, keys, _signals()).select(*keys, "line", "kind", "detail", "signal")


def find_zero_width(lines: DataFrame, keys: tuple) -> DataFrame:
    return _found(lines, keys, [_zero_width()]).select(*keys, "line", "kind", "detail", "signal")


def find_anomalies(blobs: DataFrame, keys: tuple, text: str = "blob") -> DataFrame:
    """Blobs and lines over their caps; a blob under the cap of a line can have neither."""
    long = blobs.where(F.length(text) > C.MAX_LINE_CHARS)
    return _found(blob_lines(long, keys, text), keys, [_anomalies()]).select(*keys, "line", "kind", "detail", "signal")


def scan(blobs: DataFrame, keys: tuple = ("source",), text: str = "blob") -> DataFrame:
    """All findings of each blob, those of the text sweep included: each line is exploded once, with all its findings in one array."""
    return _found(blob_lines(blobs, keys, text), keys, [*(a for a, _ in sweep.bank()), *_signals(), _zero_width(), _anomalies()])


#: What is said of each level.
REVIEW = "%d adverse signal(s) (%s); approve ONLY if you wrote or expected this exact text"
CAUTION = "%d informational finding(s) (e.g. embedded URL); verify they are legitimate references before approving"
CLEAN = "no injection signals detected; safe to approve"


def summarize(findings: DataFrame, blobs: DataFrame, keys: tuple = ("source",)) -> DataFrame:
    """(*keys, level, message): clean without findings, review with an adverse one, else caution."""
    adverse = severity(F.col("kind")) == "adverse"
    sums = findings.groupBy(*keys).agg(F.count_if(adverse).alias("bad"), F.count_if(~adverse).alias("mild"), F.array_join(F.array_sort(F.collect_set(F.when(adverse, F.col("kind")))), ", ").alias("kinds"))
    out = blobs.select(*keys).distinct().join(sums, list(keys), "left").na.fill({"bad": 0, "mild": 0})
    level = F.when(F.col("bad") > 0, "review").when(F.col("mild") > 0, "caution").otherwise("clean")
    message = (
        F.when(F.col("bad") > 0, F.format_string(REVIEW, "bad", "kinds"))
        .when(F.col("mild") > 0, F.format_string(CAUTION, "mild"))
        .otherwise(CLEAN)
    )
    return out.select(*keys, level.alias("level"), message.alias("message"), "bad", "mild")


def check(blobs: DataFrame, journal: DataFrame) -> DataFrame:
    """(source, sha256, approved, reason_code): is this very text approved for its source?

    Of several records of one text the latest counts. ``journal``: seq, source, sha256, status.
    """
    latest = journal.groupBy("source", "sha256").agg(F.max_by("status", "seq").alias("status"))
    out = blobs.select("source", F.sha2("blob", 256).alias("sha256")).join(latest, ["source", "sha256"], "left")
    code = F.when(F.col("status").isNull(), "unknown_content").when(F.col("status") == "approved", "approved").otherwise("baseline_not_approved")
    return out.select("source", "sha256", F.coalesce(F.col("status") == "approved", F.lit(False)).alias("approved"), code.alias("reason_code"))


def next_versions(journal: DataFrame) -> DataFrame:
    """(source, next_version): one more than the largest number of the source's ``v<N>``, v1 without any."""
    number = F.try_to_number(F.nullif(F.regexp_extract("version", r"^v(\d+)$", 1), F.lit("")), F.lit("999999999"))
    return journal.groupBy("source").agg(F.concat(F.lit("v"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("int").cast("string")).alias("next_version"))


def approve(blobs: DataFrame, journal: DataFrame, approved_at: Column) -> DataFrame:
    """Journal rows (source, version, sha256, blob_len, status, approved_at, level, content) that approve each blob."""
    level = summarize(scan(blobs), blobs)
    out = blobs.join(next_versions(journal), "source", "left").join(level.select("source", "level"), "source", "left")
    return out.select("source", F.coalesce("next_version", F.lit("v1")).alias("version"), F.sha2("blob", 256).alias("sha256"), F.length("blob").alias("blob_len"), F.lit("approved").alias("status"), approved_at.alias("approved_at"), "level", F.col("blob").alias("content"))


def latest_approved(journal: DataFrame) -> DataFrame:
    ok = journal.where("status = 'approved'")
    return ok.groupBy("source").agg(F.max_by(F.struct(*[c for c in ok.columns if c != "source"]), "seq").alias("r")).select("source", "r.*")
