"""What a package may reach: hosts, call sites and policy hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hints(findings: DataFrame, keys: tuple = ("package_id",)) -> DataFrame:
    """(*keys, fully_offline_capable, allowlist_sufficient, needs_proxy_or_block) of each package: three flags of partial results, no lists."""
    kind = F.col("kind")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = findings.groupBy(*keys).agg(some((kind == "outbound_network") & (F.col("host") != "")).alias("h"), some(kind == "outbound_dynamic").alias("d"), some(kind == "listening_port").alias("p"))
    return flags.select(*keys, (~(F.col("h") | F.col("d") | F.col("p"))).alias("fully_offline_capable"), (F.col("h") & ~F.col("d")).alias("allowlist_sufficient"), F.col("d").alias("needs_proxy_or_block"))


def profile(findings: DataFrame, keys: tuple = ("package_id",)) -> DataFrame:
    """One row a package: sorted static hosts, call sites in the order of seq, three policy hints. A row has all call sites of its package, as a report does.

    ``findings``: *keys, seq, kind, file, line, detail, host, fqn.
    """
    site = F.struct("seq", "file", "line", "fqn")
    sites = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, site))), lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"), s["fqn"].alias("fqn")))
    hosts = F.array_sort(F.collect_set(F.when((F.col("kind") == "outbound_network") & (F.col("host") != ""), F.col("host"))))
    out = findings.groupBy(*keys).agg(hosts.alias("static_hosts"), sites("outbound_dynamic").alias("dynamic_callsites"), sites("subprocess").alias("subprocess_callsites"), sites("listening_port").alias("listening_ports"))
    some = lambda c: F.size(c) > 0
    return out.withColumns({
        "fully_offline_capable": ~(some("static_hosts") | some("dynamic_callsites") | some("listening_ports")),
        "allowlist_sufficient": some("static_hosts") & ~some("dynamic_callsites"),
        "needs_proxy_or_block": some("dynamic_callsites"),
    })
