"""Which role a package has, and how its weights differ from the plugin's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import dims

#: Fixed values: (ecosystem, prefix, profile), in the order in which prefixes are asked; those of tool servers go before exact names.
NAME_PREFIXES = [
    ("pypi", "mcp-server-", "mcp-server"),
    ("npm", "@modelcontextprotocol/server-", "mcp-server"),
    ("npm", "mcp-server-", "mcp-server"),
    ("npm", "@aws-sdk/", "cloud-sdk"),
    ("npm", "@azure/storage-", "cloud-sdk"),
    ("npm", "@azure/identity", "cloud-sdk"),
    ("npm", "@azure/keyvault-", "cloud-sdk"),
    ("npm", "@azure/data-", "cloud-sdk"),
    ("npm", "@google-cloud/", "cloud-sdk"),
    ("npm", "@sentry/", "observability"),
    ("npm", "@opentelemetry/", "observability"),
    ("npm", "@datadog/", "observability"),
    ("npm", "@elastic/apm-", "observability"),
    ("npm", "@nestjs/", "web-framework"),
    ("npm", "@temporalio/", "workflow-orchestrator"),
    ("npm", "@docusaurus/", "doc-builder"),
    ("npm", "@vuepress/", "doc-builder"),
    ("npm", "@langchain/", "agentic-framework"),
    ("npm", "@llamaindex/", "agentic-framework"),
    ("npm", "@anthropic-ai/", "agentic-framework"),
]
#: A starting allow-list of well-known public names; ``name_table`` takes a full one as a parameter.
KNOWN_NAMES = {
    ("pypi", "mcp-server"): "mcp fastmcp",
    ("pypi", "cli-framework"): "click typer rich fire docopt",
    ("pypi", "network-library"): "requests httpx urllib3 aiohttp websockets",
    ("pypi", "web-server"): "uvicorn gunicorn hypercorn waitress",
    ("pypi", "build-tool"): "setuptools wheel hatchling flit poetry-core",
    ("pypi", "data-science"): "numpy pandas scipy matplotlib polars",
    ("pypi", "ml-framework"): "torch tensorflow transformers scikit-learn keras",
    ("pypi", "database-driver"): "psycopg2 sqlalchemy pymongo redis asyncpg",
    ("pypi", "template-engine"): "jinja2 mako chameleon",
    ("pypi", "test-framework"): "pytest tox nox hypothesis coverage",
    ("pypi", "cloud-sdk"): "boto3 botocore google-cloud-storage azure-core",
    ("pypi", "observability"): "sentry-sdk opentelemetry-sdk structlog ddtrace",
    ("pypi", "format-codec"): "pillow lxml pyyaml openpyxl",
    ("pypi", "scraping"): "scrapy selenium playwright beautifulsoup4",
    ("pypi", "web-framework"): "django flask fastapi starlette tornado",
    ("pypi", "async-runtime"): "anyio trio gevent twisted",
    ("pypi", "task-queue"): "celery rq dramatiq huey",
    ("pypi", "notebook-runtime"): "ipython jupyterlab notebook ipykernel",
    ("pypi", "data-app"): "streamlit gradio dash",
    ("pypi", "workflow-orchestrator"): "apache-airflow prefect dagster luigi",
    ("pypi", "doc-builder"): "sphinx mkdocs pdoc",
    ("pypi", "agentic-framework"): "langchain llama-index autogen crewai",
    ("pypi", "gui-toolkit"): "pyqt5 pyside6 kivy wxpython",
    ("npm", "cli-framework"): "commander yargs chalk inquirer",
    ("npm", "network-library"): "axios got node-fetch undici",
    ("npm", "dev-server-bundler"): "vite webpack-dev-server parcel",
    ("npm", "build-tool"): "webpack rollup esbuild typescript",
    ("npm", "database-driver"): "pg mongoose mysql2 ioredis",
    ("npm", "test-framework"): "jest mocha vitest cypress",
    ("npm", "web-framework"): "express koa fastify next",
}


def name_table(spark: SparkSession, extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    """(ecosystem, name, profile, priority); ``extra`` rows come first."""
    rows = [*extra, *((e, n, p) for (e, p), names in KNOWN_NAMES.items() for n in names.split())]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ecosystem string, name string, profile string, priority int")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A full allow-list from a CSV file without head: ecosystem, name, profile; of one name the first in the order of profiles counts."""
    rows = spark.read.schema("ecosystem string, name string, profile string").csv(path)
    return rows.withColumn("priority", F.array_position(F.array(*[F.lit(p) for p in C.PROFILES]), F.col("profile")).cast("int"))


def by_name(packages: DataFrame, names: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """``packages`` (ecosystem, name, …) with the profile of the best match: the one of least priority, or null.

    Exact names are an equi-join with the allow-list, of any size; so are prefixes (:func:`by_prefix`), those of :func:`prefix_table` if none are given.
    An exact name goes before a prefix, but for the tool-server prefixes, which go first.
    """
    exact = names.groupBy("ecosystem", "name").agg(F.min_by("profile", "priority").alias("_exact"))
    prefixes = prefixes if prefixes is not None else prefix_table(packages.sparkSession)
    found = by_prefix(packages.select("ecosystem", "name").distinct(), prefixes)
    out = packages.join(exact, ["ecosystem", "name"], "left").join(found, ["ecosystem", "name"], "left")
    server = F.when(F.col("_server"), "mcp-server")
    return out.withColumn("profile", F.coalesce(server, "_exact", "_prefixed")).drop("_exact", "_prefixed", "_server")


def prefix_table(spark: SparkSession) -> DataFrame:
    """(ecosystem, prefix, profile, priority) of ``NAME_PREFIXES``; a table of any size can stand in its place."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(NAME_PREFIXES)], "ecosystem string, prefix string, profile string, priority int")


def by_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(ecosystem, name, _server, _prefixed): of the distinct ``names`` that begin with a prefix, whether it is a tool server's, and of the other prefixes the profile of least priority.

    A name is cut to every length that prefixes of its ecosystem have, and these beginnings meet the prefixes by a join on equality, so
    the work grows with the names, not with names times prefixes.
    """
    lengths = prefixes.groupBy("ecosystem").agg(F.collect_set(F.length("prefix")).alias("_lengths"))  # as many as a name has characters, at most
    cuts = names.join(lengths, "ecosystem").select("ecosystem", "name", F.explode(F.filter("_lengths", lambda n: n <= F.length("name"))).alias("_n"))
    cuts = cuts.select("ecosystem", "name", F.substr("name", F.lit(1), F.col("_n")).alias("prefix"))
    met = cuts.hint("merge").join(prefixes, ["ecosystem", "prefix"])
    server = F.col("profile") == "mcp-server"
    return met.groupBy("ecosystem", "name").agg(F.bool_or(server).alias("_server"), F.min_by("profile", F.when(~server, F.col("priority"))).alias("_prefixed"))


def resolve(explicit: Column, pinned: Column, by_name_: Column, registrations: Column, entry_points: Column) -> tuple[Column, Column]:
    """(profile, reason), in the order: explicit, baseline's pin, name, registrations in the code, entry points, plugin.

    ``registrations`` and ``entry_points`` are counts (null is none).
    """
    tools, points = F.coalesce(registrations, F.lit(0)), F.coalesce(entry_points, F.lit(0))
    profile = F.coalesce(explicit, pinned, by_name_, F.when(tools >= 1, "mcp-server"), F.when(points >= 1, "cli-framework"), F.lit(C.DEFAULT_PROFILE))
    reason = F.coalesce(
        F.when(explicit.isNotNull(), "explicit"), F.when(pinned.isNotNull(), F.concat(F.lit("library-baseline: pinned profile "), pinned)), F.when(by_name_.isNotNull(), "name-allowlist"),
        F.when(tools >= 1, F.format_string("content: %d registration(s)", tools)), F.when(points >= 1, F.format_string("metadata: %d entry point(s)", points)), F.lit("default"),
    )
    return profile, reason


def weight_deltas(spark: SparkSession) -> DataFrame:
    """(profile, kind, per_delta, cap_delta, delta): the cells in which a profile differs from the plugin."""
    w = dims.weights(spark)
    base = w.where(F.col("profile") == C.DEFAULT_PROFILE).select("kind", F.col("per_finding").alias("p0"), F.col("cap").alias("c0"))
    out = w.join(F.broadcast(base), "kind").withColumns({"per_delta": F.col("per_finding") - F.col("p0"), "cap_delta": F.col("cap") - F.col("c0")})
    signed = lambda c: F.concat(F.when(c > 0, "+").otherwise(""), c.cast("string"))
    text = F.concat(F.lit("per_finding "), signed(F.col("per_delta")), F.lit(", cap "), signed(F.col("cap_delta")))
    return out.where("per_delta != 0 OR cap_delta != 0").select("profile", "kind", "per_delta", "cap_delta", text.alias("delta"))


def relaxed_and_stricter(spark: SparkSession) -> DataFrame:
    """(profile, relaxed, stricter): sorted kinds that weigh less or more than in the plugin."""
    d = weight_deltas(spark)
    less, more = (F.col("per_delta") < 0) | (F.col("cap_delta") < 0), (F.col("per_delta") > 0) | (F.col("cap_delta") > 0)
    kinds = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("kind"))))
    return dims.profiles(spark).join(d, "profile", "left").groupBy("profile").agg(kinds(less).alias("relaxed"), kinds(more).alias("stricter"))
