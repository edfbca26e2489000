"""The audit of packages: files to findings to reports.

Every detector reads the files it is for; their findings are one table with one shape. Nothing is gathered but the findings
themselves: files stay where they are, and only counts and hosts of findings shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources.scratch import cut
from . import javascript, mcp, profiles, python_ast, scoring, sweep

#: Fields of a finding beside its place, kind, detail and confidence.
EXTRA = {
    "host": "string", "fqn": "string", "mode": "string", "method": "string", "builtin": "string", "shape": "string", "length": "int", "entropy": "double",
    "env_name": "string", "stage": "string", "name": "string", "decorator": "string", "doc": "string", "owner": "string", "marker": "string", "server": "string", "reason": "string",
}
#: In a file: syntax or tokens, then the sweep, then registrations; launch configurations come after all files.
_CODE, _TEXT, _TOOLS, _LAUNCH = range(4)


def _shaped(found: DataFrame, part: Column, place: Column) -> DataFrame:
    """``found`` with all fields of a finding and where it stands among a package's findings."""
    have = set(found.columns)
    given = lambda c, kind, other: (F.col(c) if c in have else other).cast(kind).alias(c)
    order = F.struct((part == _LAUNCH).alias("last"), "rel", part.alias("part"), F.coalesce(F.col("line"), F.lit(0)).alias("line") if "line" in have else F.lit(1).alias("line"), place.alias("place"))
    return found.select("package_id", F.col("rel").alias("file"), order.alias("_order"), "kind", given("line", "int", F.lit(1)), "detail", given("confidence", "string", F.lit("literal")), *[given(c, k, F.lit(None)) for c, k in EXTRA.items()])


def _python(files: DataFrame) -> DataFrame:
    """Findings of Python files; a registered function whose description looks like an injection has one or two rows more."""
    found = python_ast.detect(files)
    tool = F.col("kind").isin("mcp_tool", "mcp_resource")
    more = F.when(tool, mcp.injections(F.coalesce("doc", F.lit("")), F.col("name")))
    kept = [c for c in found.columns if c not in ("package_id", "rel", "seq", "line", "kind", "detail")]
    own = F.struct("kind", "detail", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("marker"))
    each = found.select(*found.columns, F.posexplode(F.concat(F.array(own), F.coalesce(more, F.array().cast("array<struct<kind:string,detail:string,owner:string,marker:string>>")))).alias("_n", "_f"))
    # what a hint says is of the hint, not of the function it stands at
    rest = [F.when(F.col("_n") == 0, F.col(c)).alias(c) for c in kept if c != "confidence"]
    flat = each.select("package_id", "rel", "line", F.col("_f.kind").alias("kind"), F.col("_f.detail").alias("detail"), "confidence", *rest, "_f.owner", "_f.marker", (F.col("seq") * 4 + F.col("_n")).alias("_place"), tool.alias("_tool"))
    return _shaped(flat, F.when(F.col("_tool"), _TOOLS).otherwise(_CODE), F.col("_place"))


def findings(files: DataFrame) -> DataFrame:
    """(package_id, seq, file, kind, line, detail, confidence, and the fields of ``EXTRA``) of all detectors.

    ``files``: package_id, rel, language, text. seq numbers a package's findings: file by file in the order of their paths, in a file syntax
    before text before registrations, launch configurations last.
    """
    part = F.lit
    js = javascript.detect(files)
    found = [
        _python(files),
        _shaped(js, part(_CODE), F.col("seq")),
        _shaped(sweep.sweep(files), part(_TEXT), F.col("ordinal")),
        _shaped(mcp.js_registrations(files), part(_TOOLS), F.col("ordinal")),
        _shaped(mcp.js_injections(files).withColumn("line", F.lit(1)), part(_TOOLS), F.lit(1 << 20)),
        _shaped(mcp.launch_drift(files), part(_LAUNCH), F.xxhash64("server", "reason")),
    ]
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    return all_.withColumn("seq", F.row_number().over(W.partitionBy("package_id").orderBy("_order")).cast("long")).drop("_order")


def report(files: DataFrame, given: DataFrame | None = None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, findings) of every package of ``files``, those without any finding included.

    reports: package_id, ecosystem, name, version, files_audited, target_hash, profile, profile_reason, final_score, role_typical_share (three
    places), critical, n_findings. ``given``: package_id with explicit and pinned profiles (either may be null). ``names``: the allow-list of
    :func:`profiles.by_name`. findings have the package's profile and are those that are left after hosts were told apart.
    """
    kept = cut(scoring.dedupe_hosts(findings(files)))
    runtime = scoring.runtime_findings(kept).where("kind IN ('mcp_tool', 'mcp_resource')").groupBy("package_id").agg(F.count(F.lit(1)).alias("registrations"))
    counts = files.groupBy("package_id").agg(F.count(F.lit(1)).alias("files_audited"))
    about = S.metadata(files)
    about = profiles.by_name(about, names if names is not None else profiles.name_table(files.sparkSession)).withColumnRenamed("profile", "named")
    given = given.select("package_id", "explicit", "pinned") if given is not None else about.select("package_id", F.lit(None).cast("string").alias("explicit"), F.lit(None).cast("string").alias("pinned"))
    about = about.join(counts, "package_id").join(runtime, "package_id", "left").join(given, "package_id", "left")
    profile, reason = profiles.resolve(F.col("explicit"), F.col("pinned"), F.col("named"), F.col("registrations"), F.col("entry_points"))
    about = cut(about.select("package_id", "ecosystem", "name", "version", "files_audited", profile.alias("profile"), reason.alias("profile_reason")))
    kept = kept.join(about.select("package_id", "profile"), "package_id")
    scores = scoring.score(kept, about)
    found = kept.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_findings"))
    out = about.drop("profile").join(scores, "package_id").join(S.content_hash(files), "package_id").join(found, "package_id", "left")
    share = scoring.rounded_share(F.col("role_typical_deducted"), F.col("deducted"))
    return out.select(
        "package_id", "ecosystem", "name", "version", "files_audited", "target_hash", "profile", "profile_reason", "final_score",
        share.alias("role_typical_share"), "critical", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"),
    ), kept
