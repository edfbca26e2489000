"""What packages declare that they depend on, and which versions satisfy it."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from .scratch import cut


def normal_path(path: Column) -> Column:
    """``path`` without empty and ``.`` parts, and with each ``..`` taken back."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def under(base: Column, path: Column) -> Column:
    """``path`` as seen from the folder ``base``; absolute paths stay."""
    return normal_path(F.when(path.startswith("/") | base.isNull() | (base == ""), path).otherwise(F.concat(base, F.lit("/"), path)))


def includes(roots: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, unreadable) of requirement files with all that they include by ``-r``, however deep, each file once for a root.

    ``roots``: root (any type), path and, if their order counts, place. ``files``: path, text; a null text can't be read. lines: root, place, said, without comments,
    blanks and options, in the order of ``place``. unreadable: root, path of files that are wanted and aren't there or can't be read.
    A file that is reached on several ways has the place of the first. A loop of joins, one for each level of inclusion; it ends when
    no file is new or comes earlier, so files that include each other end it, too.
    """
    each = files.where("text IS NOT NULL").select("path", F.posexplode(T.lines("text")).alias("line", "said"))
    each = each.select("path", "line", F.regexp_replace(F.regexp_replace("said", "(?s)#.*$", ""), r"(?U)^\s+|\s+$", "").alias("said")).where("said != ''")
    target = F.nullif(F.regexp_extract("said", r"(?U)^(?:-r|--requirement)\s+(\S.*)$", 1), F.lit(""))
    each = cut(each.withColumn("target", under(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), target)))
    links = each.where("target IS NOT NULL").select(F.col("path").alias("parent"), "line", "target")
    place = F.col("place") if "place" in roots.columns else F.lit("")
    least = lambda df: df.groupBy("root", "path").agg(F.min("place").alias("place"))
    reached = frontier = cut(least(roots.select("root", normal_path(F.col("path")).alias("path"), place.alias("place"))))
    while True:
        step = least(frontier.join(links, frontier.path == links.parent).select("root", F.col("target").alias("path"), F.concat("place", F.lit("/"), F.lpad(F.col("line").cast("string"), 9, "0")).alias("place")))
        known = reached.select("root", "path", F.col("place").alias("known"))
        frontier = cut(step.join(known, ["root", "path"], "left").where("known IS NULL OR place < known").drop("known"))
        if frontier.isEmpty():
            break
        reached = cut(least(reached.unionByName(frontier)))
    unreadable = reached.join(files.where("text IS NOT NULL").select("path"), "path", "left_anti").select("root", "path")
    own = each.where("target IS NULL AND NOT startswith(said, '-')")
    lines = reached.join(own, "path").select("root", F.concat("place", F.lit("/"), F.lpad(F.col("line").cast("string"), 9, "0")).alias("place"), "said")
    return lines, unreadable


def _names(lines: DataFrame) -> DataFrame:
    """(root, specs): the declared names, each once whatever its case, in the order in which they come."""
    name = F.regexp_extract(F.regexp_extract("said", r"(?s)^([^;]*)", 1), r"(?U)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    each = lines.select("root", "place", name.alias("name")).where("name != ''")
    once = each.groupBy("root", F.lower("name").alias("low")).agg(F.min(F.struct("place", "name")).alias("n"))
    return once.groupBy("root").agg(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["name"]).alias("specs"))


def _project_entries(text: str) -> tuple[bool, list[str]]:
    """Entries of a pyproject.toml: dependencies, then optional ones, then dependency groups; not readable if it is no TOML."""
    try:
        data = tomllib.loads(text)
        project = data.get("project") or {}
        groups = [project.get("dependencies"), *(project.get("optional-dependencies") or {}).values(), *(data.get("dependency-groups") or {}).values()]
    except (tomllib.TOMLDecodeError, AttributeError, TypeError):
        return False, []
    return True, [x for g in groups if isinstance(g, list) for x in g if isinstance(x, str)]


def from_files(asked: DataFrame, files: DataFrame, keys: tuple) -> DataFrame:
    """``asked`` (rows of ``commands.installs`` with cwd) with specs and block_reason of what files declare.

    ``files``: path, text. Requirement files are read with what they include. A project is the folder that the command names, else the
    nearest folder above cwd (and cwd itself) that has a pyproject.toml. What can't be read blocks; what declares nothing is left out.
    """
    @F.pandas_udf("struct<readable:boolean,declared:array<string>>")
    def project_entries(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_project_entries(t) for t in texts], columns=["readable", "declared"])

    one = cut(asked.withColumn("root", F.struct(*keys, "ordinal")))
    wanted = one.where("reads = 'requirements' AND size(files) > 0").select("root", F.posexplode(F.transform("files", lambda f: under(F.col("cwd"), f))).alias("n", "path"))
    wanted = wanted.select("root", "path", F.lpad(F.col("n").cast("string"), 9, "0").alias("place"))
    lines, unreadable = includes(wanted, files)
    bad = unreadable.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("bad"))
    folder = under(F.col("cwd"), F.coalesce("project", F.lit(".")))
    parts = F.split(folder, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = F.when(F.col("project").isNotNull(), F.array(folder)).otherwise(up)
    near = one.where("reads = 'project'").select("root", F.posexplode(folders).alias("steps", "folder")).withColumn("path", F.concat("folder", F.lit("/pyproject.toml")))
    projects = files.where("text IS NOT NULL AND path LIKE '%/pyproject.toml'").select("path", project_entries("text").alias("p"))
    found = near.join(projects, "path").groupBy("root").agg(F.min_by("p", "steps").alias("p"))
    declared = found.select("root", F.posexplode("p.declared").alias("n", "said")).select("root", F.lpad(F.col("n").cast("string"), 9, "0").alias("place"), "said")
    names = _names(lines.unionByName(declared))
    out = one.join(names.withColumnRenamed("specs", "_named"), "root", "left").join(bad, "root", "left").join(found.select("root", F.col("p.readable").alias("_readable")), "root", "left")
    reason = F.when(F.col("bad").isNotNull(), F.concat(F.lit("requirements file(s) not readable: "), "bad")).when((F.col("reads") == "project") & ~F.coalesce("_readable", F.lit(False)), F.concat(F.lit("no readable pyproject.toml found from "), F.coalesce("project", "cwd", F.lit("."))))
    out = out.withColumn("block_reason", F.coalesce("block_reason", reason))
    out = out.withColumn("specs", F.when(F.col("reads").isNull(), F.col("specs")).when(F.col("block_reason").isNull(), F.coalesce("_named", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return out.where("size(specs) > 0 OR block_reason IS NOT NULL").drop("root", "_named", "bad", "_readable")


def parsed(lines: DataFrame, keys: tuple, order: str = "line") -> DataFrame:
    """(*keys, name, specifier): the first requirement of each name."""
    out = lines.select(*keys, order, N.parse_requirement(F.col("said")).alias("r")).where("r IS NOT NULL")
    return out.groupBy(*keys, F.col("r.name").alias("name")).agg(F.min_by("r.specifier", order).alias("specifier"), F.min(order).alias("ordinal"))


def declared(files: DataFrame) -> DataFrame:
    """(package_id, name, specifier, ordinal) of each package's manifest: the first kind that declares anything.

    In this order: pyproject.toml, METADATA or PKG-INFO, requires.txt up to its first section, package.json.
    """
    @F.pandas_udf("array<string>")
    def project(texts: pd.Series) -> pd.Series:
        def read(t):
            try:
                return [str(d) for d in (tomllib.loads(t).get("project") or {}).get("dependencies") or []]
            except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                return []

        return pd.Series([read(t) for t in texts])

    headers = F.transform(F.filter(T.lines(F.col("text")), lambda x: x.startswith("Requires-Dist:")), lambda x: F.trim(F.substr(x, F.lit(15))))
    before_section = T.lines(F.regexp_extract("text", r"(?s)^(.*?)(?:\n\[|\Z)", 1))
    npm = F.map_entries(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,string>"))
    npm_specs = F.transform(npm, lambda e: F.concat(e["key"], F.lit(" "), e["value"]))
    kind = lambda condition, rank, items: files.where(condition).select("package_id", F.lit(rank).alias("rank"), F.posexplode(items).alias("ordinal", "said"))
    all_ = kind("rel = 'pyproject.toml'", 1, project("text")).unionByName(kind("rel LIKE '%.dist-info/METADATA' OR rel LIKE '%PKG-INFO'", 2, headers))
    all_ = all_.unionByName(kind("rel LIKE '%.egg-info/requires.txt'", 3, before_section)).unionByName(kind("rel = 'package.json'", 4, npm_specs))
    first = all_.groupBy("package_id").agg(F.min("rank").alias("rank"))
    return parsed(all_.join(first, ["package_id", "rank"]), ("package_id",), "ordinal")
