"""Columns about text: lines, hosts, entropy, hints and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: Where a line ends, CRLF first; the same eleven terminators that Python's ``splitlines`` knows.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def unicode(pattern: str) -> Column:
    """``pattern`` with classes, word ends and case that know all of Unicode."""
    return F.lit("(?U)" + pattern)


def strip(text: Column) -> Column:
    """Without any white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """Array of lines without their ends; an end after the last line starts no further one, empty text has none."""
    all_ = F.split(text, LINE_END)
    return F.when(F.element_at(all_, -1) == "", F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_)


def secret_name(name: Column) -> Column:
    return F.rlike(name, F.lit(C.SECRET_NAME))


def kept_host(host: Column) -> Column:
    """False for local and documentation hosts; sub-domains of the documentation hosts are kept."""
    return ~host.isin(C.LOCAL_HOSTS + C.DOC_HOSTS) & ~F.rlike(host, F.lit("(" + "|".join(t.replace(".", r"\.") for t in C.DOC_TLDS) + ")$"))


def host_kind(host: Column) -> Column:
    return F.when(host.isin(C.TELEMETRY_HOSTS), "telemetry_endpoint").otherwise("hardcoded_host")


def non_routable(ip: Column) -> Column:
    """Addresses that reach no host on the internet: loopback, private, link-local, documentation, multicast and above."""
    octet = lambda i: F.element_at(F.split(ip, r"\."), i).cast("int")
    prefixed = F.rlike(ip, F.lit("^(" + "|".join(p.replace(".", r"\.") for p in C.NON_ROUTABLE_PREFIXES) + ")"))
    return prefixed | ((octet(1) == 172) & octet(2).between(16, 31)) | (octet(1) >= 224)


def url_host(url: Column) -> Column:
    """Lower-cased host of an absolute URL; also with characters that ``parse_url`` refuses."""
    return F.lower(F.regexp_extract(url, C.URL, 1))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of the characters of ``s``; 0 for an empty one."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)), F.lit(0.0))


def collapse(text: Column, most: int = 200) -> Column:
    """White space runs as one space, cut at ``most`` characters with an ellipsis."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def finding_hint(extra: Column, file: Column, line: Column) -> Column:
    """The first of host, fqn, name, env_name, method that is there, and the place."""
    said = F.coalesce(*[F.nullif(extra[k], F.lit("")) for k in ("host", "fqn", "name", "env_name", "method")], F.lit(""))
    return F.concat(F.when(said != "", F.concat(said, F.lit(" "))).otherwise(""), F.lit("["), file, F.lit(":"), line.cast("string"), F.lit("]"))


def percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def verdict_summary(blocked: Column, name: Column, status: Column, reasons: Column) -> Column:
    """One line: OK or BLOCK, the package, its status and the reasons."""
    head = F.format_string("%s %s: %s", F.when(blocked, "BLOCK").otherwise("OK"), name, status)
    return F.when(F.size(reasons) > 0, F.concat(head, F.lit(" ("), F.array_join(reasons, "; "), F.lit(")"))).otherwise(head)


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def age_days(now: Column, then: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400.0
