"""Columns about package names, specs and requirements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_name(name: Column, ecosystem: Column) -> Column:
    """pypi: runs of ``-_.`` become one dash, lower case. npm: lower case unless scoped."""
    pypi = F.lower(F.regexp_replace(name, "[-_.]+", "-"))
    return F.when(ecosystem == "pypi", pypi).when(name.startswith("@"), name).otherwise(F.lower(name))


def spec_ecosystem(raw: Column) -> Column:
    return F.when(raw.startswith("@"), "npm").otherwise("pypi")


def parse_spec(raw: Column, ecosystem: Column) -> Column:
    """struct(name, version, error) of ``name==version`` (pypi) or ``name@version`` (npm, scoped or not)."""
    blank = lambda c: F.nullif(c, F.lit(""))
    pattern = r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)(?:==(.+))?$"
    fits = F.rlike(raw, F.lit(pattern))
    scoped = raw.startswith("@")
    npm_name = F.when(scoped, F.regexp_extract(raw, r"^(@[^@]*)", 1)).otherwise(F.regexp_extract(raw, r"^([^@]*)", 1))
    at = F.locate("@", raw, 2) > 0
    npm_version = F.when(scoped & at, F.regexp_extract(raw, r"^@[^@]*@(.*)$", 1)).when(~scoped & raw.contains("@"), F.regexp_extract(raw, r"^[^@]*@(.*)$", 1))
    npm = ecosystem == "npm"
    name = F.when(npm, npm_name).when(fits, F.regexp_extract(raw, pattern, 1))
    version = F.when(npm, npm_version).when(fits, blank(F.regexp_extract(raw, pattern, 2)))
    error = F.when(~npm & ~fits, F.concat(F.lit("invalid pypi spec: "), raw))
    return F.struct(canonical_name(name, ecosystem).alias("name"), version.alias("version"), error.alias("error"))


def format_spec(name: Column, version: Column, ecosystem: Column) -> Column:
    mark = F.when(ecosystem == "npm", "@").otherwise("==")
    return F.when(version.isNull() | (version == ""), name).otherwise(F.concat(name, mark, version))


def extra_only(marker: Column) -> Column:
    return marker.contains("extra") & marker.contains("==")


def parse_requirement(text: Column) -> Column:
    """struct(name, specifier), or null for an empty line, an extra-only marker or no name."""
    body = F.trim(F.regexp_extract(text, r"(?s)^([^;]*)", 1))
    marker = F.regexp_extract(text, r"(?s)^[^;]*;(.*)$", 1)
    pattern = r"^(@?[A-Za-z0-9][A-Za-z0-9._/-]*)"
    raw = F.regexp_extract(body, pattern, 1)
    rest = F.trim(F.substring(body, F.length(raw) + 1, F.length(body)))
    rest = F.trim(F.regexp_replace(rest, r"^\[[^\]]*\]", ""))
    rest = F.when(F.rlike(rest, F.lit(r"(?s)^\(.*\)$")), F.trim(F.substring(rest, F.lit(2), F.length(rest) - 2))).otherwise(rest)
    name = canonical_name(raw, F.when(raw.startswith("@"), "npm").otherwise("pypi"))
    return F.when((raw != "") & ~extra_only(marker), F.struct(name.alias("name"), F.nullif(rest, F.lit("")).alias("specifier")))


def non_registry_specifier(specifier: Column) -> Column:
    """npm specifiers that name no version in the registry: git, http, file, an alias, or a path."""
    said = F.lower(F.trim(specifier))
    return F.rlike(said, F.lit(r"^(git\+|git:|https?://|file:|npm:)")) | said.contains("/")


#: Fixed value: what a package of a registry can be called on a command line.
REGISTRY_SPEC = r"^(?:@[A-Za-z0-9._-]+/)?[A-Za-z0-9._-]+(?:[@=]{1,2}[A-Za-z0-9._+\-]+)?$"


def registry_spec(token: Column) -> Column:
    """Whether an install token names a package of a registry, and not a path, an archive or a file."""
    path = F.rlike(token, F.lit(r"[/\\:]")) & ~token.startswith("@")
    file = F.rlike(token, F.lit(r"\.(txt|whl|tar\.gz|tgz)$")) | token.isin(".", "..")
    return ~path & ~file & F.rlike(token, F.lit(REGISTRY_SPEC))


def literal_version(version: Column) -> Column:
    """Whether what follows a name pins one version: no range operator in it, but for ``==`` in front."""
    return ~F.rlike(F.regexp_replace(version, "^==", ""), F.lit(r"[=<>~^!]"))
