"""Package files from a directory of landed packages, or from a table, as source_files."""

from __future__ import annotations

import hashlib
import io
import tarfile
import tomllib
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import text as T

ARCHIVE_GLOB = "*.{gz,tgz,zip,whl}"


def scan(spark: SparkSession, root: str, package_audit: bool = True) -> DataFrame:
    """source_files (package_id, rel, language, text) below ``root``, whose first folders are the packages.

    Skipped folders are dropped by path before any content is decoded; files that are not text are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), "^" + base.replace(".", r"\.") + "/", "")
    package, rel = F.regexp_extract(inside, r"^([^/]+)/", 1), F.regexp_replace(inside, r"^[^/]+/", "")
    return classify(raw.select(package.alias("package_id"), rel.alias("rel"), "content"), package_audit)


def classify(raw: DataFrame, package_audit: bool = True) -> DataFrame:
    """(package_id, rel, content) to (package_id, rel, language, text)."""
    kept = raw.where(~P.skipped(F.col("rel"), package_audit)).withColumn("language", P.language(F.col("rel"))).where("language != 'binary'")
    return kept.select("package_id", "rel", "language", decode(F.col("content")).alias("text"))


def decode(content: Column) -> Column:
    """UTF-8 with replacement characters for what isn't, and line feeds for all line ends."""
    return T.universal_newlines(F.make_valid_utf8(content.cast("string")))


def content_hash(files: DataFrame, keys: tuple = ("package_id",)) -> DataFrame:
    """(*keys, target_hash): sha256 over path, NUL, text, NUL of the files in the order of their paths.

    A null path or text counts as empty. A package's files come in order through one task, as one hash over all of
    them needs; the sort spills and the hash is fed file by file, so a package can be larger than memory. Packages
    are independent.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    said = files.select(*keys, known("rel"), known("text"))
    schema = ", ".join(f"`{k}` {said.schema[k].dataType.simpleString()}" for k in keys) + ", target_hash string"

    def run(batches):
        current = digest = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            paths, texts = (batch.column(len(keys) + i) for i in (0, 1))
            for i, key in enumerate(zip(*columns)):
                if digest is None or key != current:
                    if digest is not None:
                        yield _hashed(current, keys, digest, batch.schema)
                    current, digest = key, hashlib.sha256()
                for part in (paths[i], texts[i]):
                    digest.update(part.as_py())
                    digest.update(b"\0")
        if digest is not None:
            yield _hashed(current, keys, digest, batch.schema)

    placed = said.repartition(*keys).sortWithinPartitions(*keys, "rel", "text")
    return placed.select(*keys, F.col("rel").cast("binary"), F.col("text").cast("binary")).mapInArrow(run, schema)


def _hashed(key: tuple, keys: tuple, digest, schema: pa.Schema) -> pa.RecordBatch:
    values = [pa.array([v], schema.field(i).type) for i, v in enumerate(key)]
    return pa.RecordBatch.from_arrays([*values, pa.array([digest.hexdigest()])], [*keys, "target_hash"])


def audit_root(files: DataFrame, ecosystem: str = "ecosystem") -> DataFrame:
    """``files`` below their audit root: ``package/`` of npm, or the only folder at the top, is taken off the paths."""
    top = F.regexp_extract("rel", r"^([^/]+)/", 1)
    tops = files.groupBy("package_id").agg(F.collect_set(top).alias("_tops"))
    out = files.join(tops, "package_id")
    npm = (F.col(ecosystem) == "npm") & F.array_contains("_tops", "package")
    prefix = F.when(npm, "package/").when((F.size("_tops") == 1) & (F.element_at("_tops", 1) != ""), F.concat(F.element_at("_tops", 1), F.lit("/"))).otherwise("")
    out = out.withColumn("_prefix", prefix).where(F.col("rel").startswith(F.col("_prefix")))
    return out.withColumn("rel", F.substring("rel", F.length("_prefix") + 1, F.length("rel"))).drop("_tops", "_prefix")


#: What a batch of unpacked files has, at most, beside its last file.
BATCH_BYTES = 4 << 20


def _members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of an archive's files, one after the other; paths that leave the archive are left out."""
    inside = lambda p: not PurePosixPath(p).is_absolute() and ".." not in PurePosixPath(p).parts
    if name.endswith((".zip", ".whl")):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and inside(i.filename))
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile() and inside(m.name))


def _unpacked(package: str, path: str, content: bytes) -> Iterator[tuple]:
    try:
        for rel, own in _members(path, content):
            yield package, rel, own, None
    except (tarfile.TarError, zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError) as bad:
        yield package, None, None, f"{path}: {type(bad).__name__}"


def unpack(archives: DataFrame) -> DataFrame:
    """(package_id, rel, content, error) of ``archives`` (package_id, path, content).

    Files leave an archive one by one, in batches of bounded size. One that can't be read to its end gives what was read before, and a row
    without a path that says so in ``error``; error is null in all other rows.
    """

    def run(batches):
        rows, size = [], 0
        for pdf in batches:
            for archive in zip(pdf["package_id"], pdf["path"], pdf["content"]):
                for row in _unpacked(*archive):
                    rows.append(row)
                    size += len(row[2] or b"")
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["package_id", "rel", "content", "error"])
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=["package_id", "rel", "content", "error"])

    return archives.select("package_id", "path", "content").mapInPandas(run, "package_id string, rel string, content binary, error string")


def archived(spark: SparkSession, root: str) -> DataFrame:
    """(package_id, path, content) of the archives below ``root``; a package is called by its archive's path there."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", ARCHIVE_GLOB).load(root)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("package_id"), "path", "content")


def from_archives(archives: DataFrame, package_audit: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, errors): source files of ``archives`` (package_id, ecosystem, path, content) below their audit roots, and what could not be read."""
    members = unpack(archives)
    known = members.where("error IS NULL").join(archives.select("package_id", "ecosystem"), "package_id")
    rooted = audit_root(known.select("package_id", "ecosystem", "rel", "content"))
    return classify(rooted, package_audit), members.where("error IS NOT NULL").select("package_id", "error")


def _project(text: str) -> tuple[str | None, str | None, int]:
    """Name, version and number of console entry points of a pyproject.toml; nothing of what is no TOML."""
    try:
        project = tomllib.loads(text).get("project") or {}
        console = (project.get("entry-points") or {}).get("console_scripts") or {}
        return project.get("name"), project.get("version"), len(project.get("scripts") or {}) + len(console)
    except (tomllib.TOMLDecodeError, AttributeError, TypeError):
        return None, None, 0


def metadata(files: DataFrame) -> DataFrame:
    """(package_id, ecosystem, name, version, entry_points): pyproject.toml goes before package.json, else unknown.

    A manifest that can't be read still says which ecosystem it is; the name is then the package's own.
    """

    @F.pandas_udf("struct<name:string,version:string,entry_points:int>")
    def toml(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_project(t) for t in texts], columns=["name", "version", "entry_points"])

    own = files.where("rel IN ('pyproject.toml', 'package.json')")
    py = own.where("rel = 'pyproject.toml'").select("package_id", toml(F.coalesce("text", F.lit(""))).alias("m")).select("package_id", F.lit(1).alias("rank"), F.lit("pypi").alias("ecosystem"), "m.*")
    j = F.from_json("text", "struct<name:string,version:string,bin:string>")
    bins = F.when(F.col("m.bin").startswith("{"), F.size(F.map_keys(F.from_json("m.bin", "map<string,string>")))).when(F.coalesce("m.bin", F.lit("")) != "", 1).otherwise(0)
    js = own.where("rel = 'package.json'").select("package_id", j.alias("m")).select("package_id", F.lit(2).alias("rank"), F.lit("npm").alias("ecosystem"), "m.name", "m.version", F.coalesce(bins, F.lit(0)).alias("entry_points"))
    found = py.unionByName(js).groupBy("package_id").agg(F.min(F.struct("rank", "ecosystem", "name", "version", "entry_points")).alias("m"))
    out = files.select("package_id").distinct().join(found, "package_id", "left")
    return out.select("package_id", F.coalesce("m.ecosystem", F.lit("unknown")).alias("ecosystem"), F.coalesce(F.nullif("m.name", F.lit("")), "package_id").alias("name"), "m.version", F.coalesce("m.entry_points", F.lit(0)).alias("entry_points"))
