"""Registrations and launch configurations of tool servers, by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import files as P
from ..functions import text as T
from . import sweep


def _registered() -> Column:
    """Array of what the line ``said`` registers, a request handler last."""
    both = F.arrays_zip(F.regexp_extract_all("said", F.lit(C.MCP_JS_REGISTER), 1).alias("verb"), F.regexp_extract_all("said", F.lit(C.MCP_JS_REGISTER), 2).alias("name"))
    row = lambda kind, detail, name, verb: F.struct(kind.alias("kind"), detail.alias("detail"), name.alias("name"), verb.alias("decorator"))
    named = F.transform(both, lambda m: row(F.when(m["verb"] == "tool", "mcp_tool").otherwise("mcp_resource"), F.concat(m["verb"], F.lit("('"), m["name"], F.lit("')")), m["name"], m["verb"]))
    handler = F.array(row(F.lit("mcp_tool"), F.lit("setRequestHandler"), F.lit("<handler>"), F.lit("handler")))
    return F.when(F.rlike("said", F.lit(C.MCP_JS_HANDLER)), F.concat(named, handler)).otherwise(named)


def js_registrations(files: DataFrame, keys: tuple = sweep.KEYS) -> DataFrame:
    """(*keys, line, ordinal, kind, detail, name, decorator) of JavaScript files: named registrations, and one row for each line that sets a request handler."""
    lines = sweep.code_lines(files.where("language = 'javascript'"), keys, comments=True)
    return lines.select(*keys, "line", F.posexplode(_registered()).alias("ordinal", "r")).select(*keys, "line", "ordinal", "r.*")


def injections(text: Column, owner: Column) -> Column:
    """Array of at most two structs (kind, detail, owner, marker): an override phrase, and zero-width or bidi-override characters."""
    row = lambda said, marker: F.struct(F.lit("prompt_injection_hint").alias("kind"), F.format_string(said, owner).alias("detail"), owner.alias("owner"), F.lit(marker).cast("string").alias("marker"))
    return F.array_compact(F.array(
        F.when(F.rlike(text, T.unicode(C.INJECTION)), row("injection-shaped text near '%s'", None)),
        F.when(F.rlike(text, F.lit(C.ZERO_WIDTH)), row("zero-width characters in description for '%s'", "zero-width")),
    ))


def js_injections(files: DataFrame, keys: tuple = sweep.KEYS, rel: str = "rel") -> DataFrame:
    """(*keys, kind, detail, owner, marker): injections in JavaScript texts of which some line registers something."""
    registers = F.exists(T.lines(F.col("text")), lambda x: F.rlike(x, F.lit(C.MCP_JS_REGISTER)) | F.rlike(x, F.lit(C.MCP_JS_HANDLER)))
    own = files.where("language = 'javascript'").where(registers)
    return own.select(*keys, F.explode(injections(F.col("text"), F.col(rel))).alias("i")).select(*keys, "i.*")


def launch_drift(files: DataFrame, keys: tuple = sweep.KEYS, rel: str = "rel") -> DataFrame:
    """Auto-accepting and unpinned servers in launch configurations; text that isn't such JSON has none.

    The arguments are read as plain JSON values, so numbers among them count as their text.
    """
    own = files.where(P.mcp_config(F.col(rel)))
    servers = F.from_json(F.get_json_object("text", "$.mcpServers"), "map<string,string>")
    each = own.select(*keys, F.explode(servers).alias("server", "entry"))
    args = F.array_join(F.from_json(F.get_json_object("entry", "$.args"), "array<string>"), " ")
    each = each.where(F.col("entry").startswith("{")).withColumn("args", F.coalesce(args, F.lit("")))
    reasons = F.array_compact(F.array(
        F.when(F.rlike("args", F.lit(r"(?:^|\s)(-y|--yes)(?:\s|$)")), "auto-accept"),
        F.when(F.col("args").contains("@latest") | F.col("args").endswith(" latest"), "unpinned"),
    ))
    out = each.select(*keys, "server", "args", F.explode(reasons).alias("reason"))
    detail = F.when(F.col("reason") == "unpinned", F.format_string("server '%s' pulls unpinned 'latest' version", "server")).otherwise(F.format_string("server '%s' launched with auto-accept flag (%s)", "server", "args"))
    return out.select(*keys, F.lit(1).alias("line"), F.lit("mcp_transport_drift").alias("kind"), detail.alias("detail"), "server", "reason")
