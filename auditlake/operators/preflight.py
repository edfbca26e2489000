"""From package files to verdicts: one package against its baseline, and whole dependency trees.

``preflight`` audits packages, finds each one's baseline in the library, holds findings against the baseline's and says what is to be
written. ``audit_tree`` goes on to what packages depend on: level by level manifests are read, specifiers are resolved in the registry, and only
versions that no tree has met before go on. Every version is audited once, however many trees it is in; trees are then walked over what was
found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import names as N
from ..functions import versions
from ..sources import journal, library, requirements
from ..sources.scratch import cut
from . import audit, closure, diff, scoring, verdict

_SPEC = ["ecosystem", "name", "version"]
_SURFACES = sorted({k for k in C.SIGNATURE_KEYS.values() if k})


def with_surfaces(findings: DataFrame) -> DataFrame:
    """``findings`` with the struct ``extra`` of the fields that name a surface."""
    have = set(findings.columns)
    return findings.withColumn("extra", F.struct(*[(F.col(k) if k in have else F.lit(None)).cast("string").alias(k) for k in _SURFACES]))


def drift(specs: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """(package_id, kind, signature, …) of findings that the baseline hasn't.

    ``specs``: package_id, baseline (a struct with version and target_hash, or null), ecosystem, name. ``found``: the candidates' findings.
    ``kept``: the findings of accepted packages, with kept_ecosystem, kept_name and kept_hash (a finding has a name of its own).
    """
    based = specs.where("baseline IS NOT NULL").select("package_id", F.col("ecosystem").alias("kept_ecosystem"), F.col("name").alias("kept_name"), F.col("baseline.target_hash").alias("kept_hash"))
    before = kept.join(based, ["kept_ecosystem", "kept_name", "kept_hash"]).drop("kept_ecosystem", "kept_name", "kept_hash")
    own = found.join(based.select("package_id"), "package_id", "left_semi")
    return diff.new_surfaces(diff.signatures(with_surfaces(own)), diff.signatures(with_surfaces(before)))


def preflight(
    specs: DataFrame, files: DataFrame, rows: DataFrame, kept: DataFrame, names: DataFrame | None = None,
    min_score: int | None = None, auto_score: int | None = None, accept_new: bool = False, pinned: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, findings) of every package of ``specs`` (package_id, ecosystem, name, version) that has files.

    ``files``: package_id, rel, language, text. ``rows``: the journal's index (:func:`auditlake.sources.journal.index`), with expected_surface_counts where
    baselines pin their counts. ``kept``: findings of what the journal accepted (:func:`drift`). With ``pinned`` a package is
    audited under the profile of its baseline. verdicts has the columns of :func:`verdict.verdicts`, package_id, n_findings, files_audited and n_new.
    """
    own = files.join(specs.select("package_id"), "package_id", "left_semi")
    given = library.pinned_profiles(specs, rows).select("package_id", F.lit(None).cast("string").alias("explicit"), "pinned") if pinned else None
    reports, found = audit.report(own, given, names)
    about = reports.drop("ecosystem", "name", "version").withColumnRenamed("final_score", "score").join(specs, "package_id")
    based = cut(verdict.baseline_of(about, rows))
    new = cut(drift(based, found, kept))
    counts = scoring.surface_counts(found)
    pins = F.col("baseline.expected_surface_counts") if "expected_surface_counts" in rows.columns else F.lit(None).cast("map<string,int>")
    novel = verdict.novel_high_risk(new, counts, based.select("package_id", pins.alias("pinned")))
    n_new = new.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_new"))
    prior = journal.prior_blocked(rows).select("ecosystem", "name", "prior")
    ready = based.join(novel, "package_id", "left").join(n_new, "package_id", "left").join(prior, ["ecosystem", "name"], "left").withColumn("accept_new", F.lit(accept_new))
    return verdict.verdicts(ready.na.fill({"n_new": 0}), min_score, auto_score), found


def to_journal(verdicts: DataFrame, first_seq: int, now: str) -> DataFrame:
    """The journal rows that verdicts ask for: what is accepted as a baseline or kept as blocked."""
    written = verdicts.where("write_status IS NOT NULL").select(*_SPEC, "target_hash", "profile", "profile_reason", "score", "role_typical_share", F.col("write_status").alias("status"))
    return journal.stamp(written.withColumn("audited_at", F.lit(now)), first_seq, now)


def version_diff(before: DataFrame, after: DataFrame, specs: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, new, removed) of two tables of files with the same package ids: two versions of packages, or a folder and what was accepted of it.

    ``specs``: package_id. The summary is that of :func:`diff.summary`.
    """
    one, two = (audit.report(f.join(specs.select("package_id"), "package_id", "left_semi"), None, names) for f in (before, after))
    a, b = (cut(diff.signatures(with_surfaces(found))) for _, found in (one, two))
    scores = one[0].select("package_id", F.col("final_score").alias("score_before"), F.col("profile").alias("profile_before")).join(two[0].select("package_id", F.col("final_score").alias("score_after"), F.col("profile").alias("profile_after")), "package_id")
    new, removed = diff.new_surfaces(b, a), diff.new_surfaces(a, b)
    return diff.summary(new, removed, scores), new, removed


def node_key(df: DataFrame) -> DataFrame:
    """``df`` with ``node``: ecosystem, name and version of a package as one text; without a version ``?`` stands for it."""
    separator = F.when(F.col("ecosystem") == "npm", "@").otherwise("==")
    return df.withColumn("node", F.concat("ecosystem", F.lit(":"), "name", separator, F.coalesce("version", F.lit("?"))))


def dependencies(roots: DataFrame, packages: DataFrame, declared: DataFrame, registry: DataFrame, max_depth: int = closure.MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all that ``roots`` (ecosystem, name, specifier) depend on, in at most ``max_depth`` steps.

    nodes: node, ecosystem, name, version (null where nothing satisfies a specifier), root (whether asked for). edges: parent, ordinal, child.
    ``packages``: package_id, ecosystem, name, version. ``declared``: package_id, name, specifier, ordinal. A level resolves what the versions
    that came up in the level before declare; a version that was met before is not looked at again.
    """
    known = cut(versions.ordered(registry))  # its versions are read once, not again in each level
    asked = roots.select("ecosystem", N.canonical_name(F.col("name"), F.col("ecosystem")).alias("name"), "specifier").distinct()
    root_nodes = node_key(versions.resolve(asked, known)).withColumn("root", F.lit(True))
    frontier = cut(root_nodes.select("node", *_SPEC, "root").distinct())
    nodes, edges = frontier, None
    wanted = packages.select("package_id", *_SPEC).join(declared.select("package_id", F.col("name").alias("asks"), "specifier", "ordinal"), "package_id")
    wanted = cut(wanted.select(*_SPEC, "asks", "specifier", "ordinal"))
    for _ in range(max_depth):
        asks = frontier.where("version IS NOT NULL").select(F.col("node").alias("parent"), *_SPEC).hint("merge").join(wanted, _SPEC)
        asks = asks.select("parent", "ordinal", "ecosystem", N.canonical_name(F.col("asks"), F.col("ecosystem")).alias("name"), "specifier")
        level = cut(node_key(versions.resolve(asks, known)))
        edges = level.select("parent", "ordinal", F.col("node").alias("child")) if edges is None else edges.unionByName(level.select("parent", "ordinal", F.col("node").alias("child")))
        frontier = cut(level.select("node", *_SPEC, F.lit(False).alias("root")).distinct().join(nodes.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        nodes = nodes.unionByName(frontier)
    return cut(nodes), cut(edges)


def audit_tree(
    roots: DataFrame, packages: DataFrame, files: DataFrame, registry: DataFrame, rows: DataFrame, kept: DataFrame,
    max_depth: int = closure.MAX_DEPTH, names: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(tree, verdicts): the dependency tree of each of ``roots`` (ecosystem, name, specifier) with the verdict of every version in it.

    ``packages`` (package_id, ecosystem, name, version) says what ``files`` holds of which version. ``registry``: ecosystem, name, version, latest.
    ``rows`` and ``kept`` are as for :func:`preflight`. tree is that of :func:`closure.tree`, its nodes being texts of :func:`node_key`, with name and version.
    A specifier that nothing satisfies, and a version without files, is an error; the first is no version, so it can't have been visited before.
    """
    nodes, edges = dependencies(roots, packages, requirements.declared(files), registry, max_depth)
    # each version is audited once; of packages that claim one version the first
    own = packages.join(nodes.where("version IS NOT NULL").select(*_SPEC), _SPEC, "left_semi").groupBy(*_SPEC).agg(F.min("package_id").alias("package_id"))
    judged = cut(preflight(cut(own), files, rows, kept, names, pinned=False)[0])
    statuses = nodes.join(judged.select(*_SPEC, "status"), _SPEC, "left").select("node", F.coalesce("status", F.lit("error")).alias("status"), F.col("version").isNull().alias("leaf"))
    walked = closure.tree(nodes.where("root").select("node"), edges, statuses, max_depth)
    return cut(walked.hint("merge").join(nodes.select("node", "name", "version"), "node")), judged
