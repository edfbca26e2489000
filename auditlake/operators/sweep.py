"""Line-by-line text sweep: hosts, addresses, secret names, encoded blobs.

All of it is Catalyst expressions: each line that can hold a finding is exploded once, with the findings of all patterns in one
array, apart from the comment mask, which is sequential within a file and runs as an Arrow UDF over code files only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import constants as C
from ..functions import text as T

KEYS = ("package_id", "rel")


def non_code_lines(text: str | None, language: str | None) -> list[int]:
    """1-based numbers of lines that a comment or a triple-quoted text begins on, goes on over or ends on.

    Strings aren't looked at: a mark inside one counts as a mark.
    """
    if not text or language not in ("python", "javascript"):
        return []
    found: list[int] = []
    closing = None
    for number, line in enumerate(text.splitlines(), 1):
        said = line.lstrip()
        if closing:
            found.append(number)
            closing = None if closing in line else closing
        elif said.startswith("#" if language == "python" else ("//", "*")):
            found.append(number)
        elif language == "python":
            mark = next((m for m in ('"""', "'''") if m in line), None)
            if mark:
                found.append(number)
                closing = mark if line.count(mark) % 2 else None
        elif "/*" in line:
            found.append(number)
            closing = None if "*/" in line.split("/*", 1)[1] else "*/"
    return found


@F.pandas_udf(ArrayType(IntegerType()))
def _mask(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([non_code_lines(t, x) for t, x in zip(text, language)])


#: What a line must hold for any finding of the sweep; it is asked of whole texts and then of lines, before they are looked at closely.
URL_HINT, IPV4_HINT, ENV_HINT, BLOB_HINT = "https?://", r"\d(?:\.\d{1,3}){3}", r"process\.env\.|os\.environ\[|os\.getenv\(", "[A-Za-z0-9+/=]{120}"
HINT = "|".join((URL_HINT, IPV4_HINT, ENV_HINT, BLOB_HINT))


def code_lines(files: DataFrame, keys: tuple = KEYS, comments: bool = False, hint: str | None = None) -> DataFrame:
    """(*keys, line, said) of ``files`` (*keys, language, text); comments only if asked for, and only lines with the ``hint`` if one is given."""
    lines = marked_lines(files, keys, hint, masked=not comments)
    return lines.select(*keys, "line", "said") if comments else lines.where("code").select(*keys, "line", "said")


def marked_lines(files: DataFrame, keys: tuple = KEYS, hint: str | None = None, masked: bool = True) -> DataFrame:
    """(*keys, line, said, code) of ``files``: code is false for lines of comments in code files.

    Texts without the ``hint`` are left out whole, before they are cut into lines. Only code goes to the comment mask.
    """
    if hint:
        files = files.where(F.rlike("text", F.lit(hint)))
    if masked:
        is_code = F.col("language").isin("python", "javascript")
        lines = files.select(*keys, F.posexplode(T.lines(F.col("text"))).alias("pos", "said"), _mask(F.when(is_code, F.col("text")), F.col("language")).alias("_mask"))
        lines = lines.select(*keys, (F.col("pos") + 1).alias("line"), "said", (~F.array_contains("_mask", F.col("pos") + 1)).alias("code"))
    else:
        lines = files.select(*keys, F.posexplode(T.lines(F.col("text"))).alias("pos", "said")).select(*keys, (F.col("pos") + 1).alias("line"), "said", F.lit(True).alias("code"))
    return lines.where(F.rlike("said", F.lit(hint))) if hint else lines


def matches(lines: DataFrame, pattern: str, keys: tuple, group: int = 0) -> DataFrame:
    """(*keys, line, ordinal, whole, part): every match on every line, with one group of it."""
    p = F.lit(pattern)
    both = F.arrays_zip(F.regexp_extract_all("said", p, 0).alias("whole"), F.regexp_extract_all("said", p, group).alias("part"))
    return lines.where(F.rlike("said", p)).select(*keys, "line", F.posexplode(both).alias("ordinal", "m")).select(*keys, "line", "ordinal", "m.whole", "m.part")


def find_urls(lines: DataFrame, keys: tuple = KEYS) -> DataFrame:
    found = matches(lines, C.URL, keys, 1).withColumn("host", F.lower("part")).where(T.kept_host(F.col("host")))
    return found.select(*keys, "line", T.host_kind(F.col("host")).alias("kind"), F.col("whole").alias("detail"), "host")


def find_ipv4(lines: DataFrame, keys: tuple = KEYS) -> DataFrame:
    found = matches(lines, C.IPV4, keys, 1).where(~T.non_routable(F.col("part")))
    return found.select(*keys, "line", F.lit("hardcoded_host").alias("kind"), F.col("part").alias("detail"), F.col("part").alias("host"))


def find_env_secrets(lines: DataFrame, keys: tuple = KEYS) -> DataFrame:
    found = matches(lines, C.ENV_REFERENCE, keys, 1).where(T.secret_name(F.col("part")))
    return found.select(*keys, "line", F.lit("env_secret_read").alias("kind"), F.col("whole").alias("detail"), F.col("part").alias("env_name"))


def find_blobs(lines: DataFrame, keys: tuple = KEYS) -> DataFrame:
    found = matches(lines, C.BASE64, keys, 1).withColumn("entropy", T.entropy(F.col("part"))).where(F.col("entropy") >= C.ENTROPY_LEAST)
    length = F.length("part")
    return found.select(*keys, "line", F.lit("obfuscation").alias("kind"), F.format_string("<base64-like blob len=%d>", length).alias("detail"), length.alias("length"), F.round("entropy", 2).alias("entropy"))


EXTRA = ("host", "env_name", "length", "entropy", "signal")


def finding(kind: Column, detail: Column, **extra) -> Column:
    """A finding as a struct that all banks of patterns share."""
    kinds = {"length": "int", "entropy": "double"}
    return F.struct(kind.alias("kind"), detail.alias("detail"), *[extra.get(k, F.lit(None)).cast(kinds.get(k, "string")).alias(k) for k in EXTRA])


def bank(said: str = "said") -> list[tuple[Column, bool]]:
    """Arrays of the findings on a line, and whether each looks at code only."""
    both = lambda p: F.arrays_zip(F.regexp_extract_all(said, F.lit(p), 0).alias("whole"), F.regexp_extract_all(said, F.lit(p), 1).alias("part"))
    only = lambda hint, found: F.when(F.rlike(said, F.lit(hint)), found)
    urls = F.filter(both(C.URL), lambda m: T.kept_host(F.lower(m["part"])))
    urls = F.transform(urls, lambda m: finding(T.host_kind(F.lower(m["part"])), m["whole"], host=F.lower(m["part"])))
    ips = F.transform(F.filter(both(C.IPV4), lambda m: ~T.non_routable(m["part"])), lambda m: finding(F.lit("hardcoded_host"), m["part"], host=m["part"]))
    names = F.transform(F.filter(both(C.ENV_REFERENCE), lambda m: T.secret_name(m["part"])), lambda m: finding(F.lit("env_secret_read"), m["whole"], env_name=m["part"]))
    blobs = F.filter(F.transform(both(C.BASE64), lambda m: F.struct(m["part"].alias("part"), T.entropy(m["part"]).alias("entropy"))), lambda m: m["entropy"] >= C.ENTROPY_LEAST)
    blobs = F.transform(blobs, lambda m: finding(F.lit("obfuscation"), F.format_string("<base64-like blob len=%d>", F.length(m["part"])), length=F.length(m["part"]), entropy=F.round(m["entropy"], 2)))
    return [(only(URL_HINT, urls), True), (only(IPV4_HINT, ips), True), (only(ENV_HINT, names), False), (only(BLOB_HINT, blobs), False)]


def gathered(arrays: list[Column]) -> Column:
    """One array of findings of several, of which any may be null."""
    none = F.array().cast("array<struct<kind:string,detail:string,host:string,env_name:string,length:int,entropy:double,signal:string>>")
    return F.concat(*[F.coalesce(a, none) for a in arrays])


def sweep(files: DataFrame, keys: tuple = KEYS) -> DataFrame:
    """(*keys, line, ordinal, kind, detail, host, env_name, length, entropy) of the sweep, in one pass over the lines.

    Comments count for secret names and blobs only.
    """
    lines = marked_lines(files, keys, HINT)
    found = gathered([F.when(F.col("code"), a) if code else a for a, code in bank()])
    out = lines.select(*keys, "line", F.posexplode(found).alias("ordinal", "f")).select(*keys, "line", "ordinal", "f.*")
    return out.drop("signal")
