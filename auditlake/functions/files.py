"""Columns about a file's path: language, context, whether it is skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def parts(rel: Column) -> Column:
    return F.split(F.regexp_replace(rel, r"\\", "/"), "/")


def file_name(rel: Column) -> Column:
    return F.element_at(parts(rel), -1)


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_suffix(name: Column, suffixes: list[str]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | name.endswith(s)
    return found


def skipped(rel: Column, package_audit: bool = False) -> Column:
    """Whether any part of the path, the file's name included, is in the skip set."""
    names = [d for d in C.SKIP_DIRS if not (package_audit and d in C.READMITTED_DIRS)]
    return F.arrays_overlap(parts(rel), literals(names))


def language(rel: Column) -> Column:
    """python, javascript, text or binary, by the lower-cased last suffix."""
    name = F.lower(file_name(rel))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return (
        F.when(suffix.isin(C.PYTHON_SUFFIXES), "python")
        .when(suffix.isin(C.JS_SUFFIXES), "javascript")
        .when(suffix.isin(C.TEXT_SUFFIXES) | name.isin(C.BARE_TEXT_NAMES), "text")
        .otherwise("binary")
    )


def context(rel: Column) -> Column:
    """What a file is for; of several answers the first in this order: tests, docs, i18n, vendored, generated, types, docs or setup at the root, runtime."""
    p = parts(rel)
    folders = F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.lower(x))
    name, root = F.lower(F.element_at(p, -1)), F.size(p) == 1
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    flat = F.translate(stem, "_-", "")
    within = lambda names: F.arrays_overlap(folders, literals(names))
    vendored = within(C.VENDORED_DIRS) | F.exists(folders, lambda x: F.rlike(x, F.lit("^(" + "|".join(C.VENDORED_PREFIXES) + ")")))
    meta = stem.isin(C.META_STEMS) | (flat.contains("notice") & flat.contains("thirdparty")) | stem.isin("licenses", "licences")
    return (
        F.when(within(C.TEST_DIRS) | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py"), "tests")
        .when(within(C.DOC_DIRS), "docs")
        .when(within(C.I18N_DIRS), "i18n")
        .when(vendored, "vendored")
        .when(within(C.GENERATED_DIRS) | any_suffix(name, C.AUTOGEN_SUFFIXES), "generated")
        .when(any_suffix(name, C.TYPE_STUB_SUFFIXES), "types")
        .when(meta & root, "docs")
        .when(name.isin(C.SETUP_FILES) & root, "setup")
        .otherwise("runtime")
    )


def mcp_config(rel: Column) -> Column:
    name = F.lower(file_name(rel))
    return name.isin(C.MCP_CONFIG_NAMES) | name.endswith("mcp.json")
