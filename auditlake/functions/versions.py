r"""Order and ranges of versions as columns.

A version becomes a text key that sorts, byte by byte, as the version does: each number is its digits with their count before
them, each part begins or ends with a sign that no other alternative has, so no key begins another. A specifier becomes
a few intervals of such keys. Whether a version satisfies a specifier is then a comparison of texts, and the best version the greatest key
of an interval; both ecosystems share one rule.

``order`` gives (key, pre, local, base), ``intervals`` an array of (low, high, no_local, no_pre, bases, exact): keys from ``low`` on and
below ``high``; without local or pre-release versions where the flags say so; where ``bases`` isn't null a pre-release only of one of these
bases; where ``exact`` isn't null only a version of just that text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import names

#: Above every key, and what is put behind a key for what comes right after it.
END, AFTER = "~", "!"
INTERVAL = "struct<low:string,high:string,no_local:boolean,no_pre:boolean,bases:array<string>,exact:string>"
_PYPI = r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(a|alpha|b|beta|c|rc|pre|preview)[-_.]?(\d*))?(?:[-_.]?(post|rev|r)[-_.]?(\d*)|-(\d+))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\z"
_NPM = r"^[v=\s]*(\d+)\.(\d+)\.(\d+)(?:-?([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?\z"
_PARTIAL = r"^(\d+|[xX*])?(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?\z"
#: Stages of a release in their order; a development release without another stage comes before all.
_DEV, _FINAL = "a", "e"
_STAGES = {"a": "b", "alpha": "b", "b": "c", "beta": "c", "c": "d", "rc": "d", "pre": "d", "preview": "d"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _number(digits: Column) -> Column:
    """Digits, none being zero, as a text that sorts by value."""
    plain = F.regexp_replace(F.when(digits == "", "0").otherwise(digits), "^0+(?=[0-9])", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 2, "0"), plain)


def _release(parts: Column) -> Column:
    """The key of release numbers, open for further ones."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("1"), _number(p))), "")


def _pypi_parts(version: Column) -> Column:
    """Struct of the prefixes of a key and the flags of a Python version; null if it is none."""

    def of(v: Column) -> Column:
        group = lambda i: F.regexp_extract(v, _PYPI, i)
        stage_name, post_name, post_minus, dev, local = group(3), group(5), group(7), group(8), group(10)
        is_post = (post_name != "") | (post_minus != "")
        code = F.lit(_FINAL)
        for name, sign in _STAGES.items():
            code = F.when(stage_name == name, sign).otherwise(code)
        stage = F.when(stage_name != "", F.concat(code, _number(group(4)))).when((dev != "") & ~is_post, F.concat(F.lit(_DEV), _number(F.lit("")))).otherwise(F.concat(F.lit(_FINAL), _number(F.lit(""))))
        epoch = _number(group(1))
        release = F.concat(_release(F.split(F.regexp_replace(group(2), r"(\.0+)+\z", ""), r"\.")), F.lit("0"))
        post = F.when(is_post, F.concat(F.lit("1"), _number(F.when(post_name != "", group(6)).otherwise(post_minus)))).otherwise("0")
        devel = F.when(dev != "", F.concat(F.lit("0"), _number(group(9)))).otherwise("1")
        local_part = lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("11"), _number(p))).otherwise(F.concat(F.lit("10"), p, F.lit("!")))
        locals_ = F.when(local != "", F.concat(F.array_join(F.transform(F.split(local, "[-_.]"), local_part), ""), F.lit("0"))).otherwise("0")
        q = F.concat(epoch, release)
        r = F.concat(q, stage)
        public = F.concat(r, post, devel)
        return F.when(
            v.rlike(_PYPI),
            F.struct(
                epoch.alias("epoch"), q.alias("q"), r.alias("r"), public.alias("public"), F.concat(public, locals_).alias("key"),
                is_post.alias("post"), (local != "").alias("local"), ((F.substring(stage, 1, 1) < _FINAL) | (dev != "")).alias("pre"),
            ),
        )

    return _let(F.lower(_strip(version)), of)


def _npm_parts(version: Column) -> Column:
    """Struct (base, key, pre, n: its three numbers) of a semantic version; null if it is none."""

    def of(v: Column) -> Column:
        group = lambda i: F.regexp_extract(v, _NPM, i)
        base = F.concat(*[_number(group(i)) for i in (1, 2, 3)])
        part = lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("10"), _number(p))).otherwise(F.concat(F.lit("11"), p, F.lit("!")))
        pre = F.when(group(4) != "", F.concat(F.lit("0"), F.array_join(F.transform(F.split(group(4), r"\."), part), ""), F.lit("0"))).otherwise("1")
        return F.when(v.rlike(_NPM), F.struct(base.alias("base"), F.concat(base, pre).alias("key"), (group(4) != "").alias("pre"), F.array(group(1), group(2), group(3)).alias("n")))

    return _let(_strip(version), of)


def order(version: Column, ecosystem: Column) -> Column:
    """(key, pre, local, base) of a version; null where it is none. base is null for Python versions."""
    pypi = _let(_pypi_parts(version), lambda p: F.when(p.isNotNull(), F.struct(p["key"].alias("key"), p["pre"].alias("pre"), p["local"].alias("local"), F.lit(None).cast("string").alias("base"))))
    npm = _let(_npm_parts(version), lambda p: F.when(p.isNotNull(), F.struct(p["key"].alias("key"), p["pre"].alias("pre"), F.lit(False).alias("local"), p["base"].alias("base"))))
    return F.when(ecosystem == "npm", npm).otherwise(pypi)


def _interval(low: Column | str, high: Column | str, no_local: bool = False, no_pre: bool = False, bases: Column | None = None, exact: Column | None = None) -> Column:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(text(low).alias("low"), text(high).alias("high"), F.lit(no_local).alias("no_local"), F.lit(no_pre).alias("no_pre"), (F.lit(None) if bases is None else bases).cast("array<string>").alias("bases"), (F.lit(None) if exact is None else exact).cast("string").alias("exact")).cast(INTERVAL)


def _increased(digits: Column) -> Column:
    return (digits.cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string")


def _pypi_clause(clause: Column) -> Column:
    """The intervals of one clause, null if it is invalid."""
    op, other = (F.regexp_extract(clause, r"^(===|==|!=|~=|<=|>=|<|>)\s*(\S+)\z", i) for i in (1, 2))
    wild = other.endswith(".*")
    numbers = F.split(F.regexp_extract(F.lower(other), r"^v?(?:\d+!)?([\d.]*\d)", 1), r"\.")

    def of(o: Column) -> Column:
        below = lambda parts: F.concat(o["epoch"], _release(F.split(F.regexp_replace(F.array_join(parts, "."), r"(\.0+)+\z", ""), r"\.")))
        beyond = lambda parts: F.concat(o["epoch"], _release(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(_increased(F.element_at(parts, -1))))))
        begins = lambda parts: (below(parts), beyond(parts))
        own = F.when(o["local"], o["key"]).otherwise(o["public"])  # a specifier without a local part speaks of public versions
        last = F.concat(own, F.lit(END))
        right_after = F.concat(o["key"], F.lit(AFTER))
        shorter = F.slice(numbers, F.lit(1), F.size(numbers) - 1)
        greater = F.when(o["post"], F.array(_interval(right_after, END))).otherwise(F.array(_interval(right_after, F.concat(o["r"], F.lit("1")), no_local=True), _interval(F.concat(o["r"], F.lit(END)), END)))
        less = F.when(o["pre"], F.array(_interval("", o["key"]))).otherwise(F.array(_interval("", o["q"]), _interval(F.concat(o["q"], F.lit(_FINAL)), o["key"], no_pre=True)))
        low, high = begins(numbers)
        plain = (
            F.when(op == "==", F.array(_interval(own, last))).when(op == "!=", F.array(_interval("", own), _interval(last, END)))
            .when(op == ">=", F.array(_interval(own, END))).when(op == "<=", F.array(_interval("", last))).when(op == ">", greater).when(op == "<", less)
            .when((op == "~=") & (F.size(numbers) > 1), F.array(_interval(own, beyond(shorter))))
        )
        starred = F.when(op == "==", F.array(_interval(low, high))).when(op == "!=", F.array(_interval("", low), _interval(high, END)))
        return F.when(o.isNotNull(), F.when(op == "===", F.array(_interval("", END, exact=other))).when(wild, starred).otherwise(plain))

    return _let(_pypi_parts(F.regexp_replace(other, r"\.\*\z", "")), of)


def _both(a: Column, b: Column) -> Column:
    """What two lists of intervals share."""
    one = lambda x, y: F.struct(
        F.greatest(x["low"], y["low"]).alias("low"), F.least(x["high"], y["high"]).alias("high"), (x["no_local"] | y["no_local"]).alias("no_local"), (x["no_pre"] | y["no_pre"]).alias("no_pre"),
        F.coalesce(x["bases"], y["bases"]).alias("bases"), F.when(x["exact"].isNull() | y["exact"].isNull() | (x["exact"] == y["exact"]), F.coalesce(x["exact"], y["exact"])).otherwise("").alias("exact"),
    ).cast(INTERVAL)
    return F.filter(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: one(x, y)))), lambda i: i["low"] < i["high"])


def _pypi_intervals(specifier: Column) -> Column:
    clauses = F.filter(F.transform(F.split(specifier, ","), _strip), lambda c: c != "")
    each = F.transform(clauses, _pypi_clause)
    everything = F.array(_interval("", END))
    return _let(each, lambda e: F.when(~F.exists(e, lambda c: c.isNull()), F.aggregate(e, everything, _both)))


def _npm_comparator(token: Column) -> Column:
    """(low, high, base of the pre-release it names or null) of (op, text); null if it is invalid."""
    start = lambda m: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: _number(F.coalesce(F.get(m, i), F.lit("0")))), ""), F.lit("00"))
    upto = lambda m, k: F.slice(m, F.lit(1), k)
    # the first version behind all that begin with these numbers
    after = lambda numbers: _let(numbers, lambda m: F.when(F.size(m) == 0, F.lit(END)).otherwise(start(F.concat(upto(m, F.size(m) - 1), F.array(_increased(F.element_at(m, -1)))))))
    zero = F.lit("010" * 3 + "00")

    def bounds(op: Column, full: Column, n: Column) -> Column:
        is_full = full.isNotNull()
        low = F.when(is_full, full["key"]).otherwise(start(n))
        above = F.concat(full["key"], F.lit(AFTER))
        behind = F.when(is_full, above).otherwise(after(n))
        # a caret keeps the numbers up to the first that isn't zero, or all; a tilde two
        lead = F.coalesce(F.nullif(F.array_position(F.transform(n, lambda x: x.rlike("[1-9]")), True), F.lit(0)), F.size(n).cast("long")).cast("int")
        kept = F.when(op == "^", lead).otherwise(F.least(F.size(n), F.lit(2)))
        from_ = F.when(op.isin("<", "<="), zero).when(op == ">", F.when(is_full | (F.size(n) > 0), behind).otherwise(zero)).otherwise(low)
        to = (
            F.when(op.isin("", "=", "<="), behind).when(op == ">=", F.lit(END)).when(op == "<", low)
            .when(op == ">", F.when(is_full | (F.size(n) > 0), F.lit(END)).otherwise(zero)).otherwise(after(upto(n, kept)))
        )
        return F.struct(from_.alias("low"), to.alias("high"), F.when(full["pre"], full["base"]).alias("base"))

    def of(text: Column) -> Column:
        leading = F.filter(F.split(F.regexp_extract(text, r"^(\d+(?:\.\d+){0,2})", 1), r"\."), lambda x: x != "")
        numbers = lambda full: F.when(full.isNotNull(), full["n"]).otherwise(leading)
        op = F.when(token["op"].startswith("~"), "~").otherwise(token["op"])
        found = lambda full: _let(op, lambda o: _let(numbers(full), lambda n: bounds(o, full, n)))
        return _let(_npm_parts(text), lambda full: F.when(full.isNotNull() | text.rlike(_PARTIAL), found(full)))

    return _let(F.regexp_replace(_strip(token["text"]), r"^[v=]+", ""), of)


def _npm_range(range_: Column) -> Column:
    """The interval of one alternative, null if it is invalid."""
    between, token = r"^\s*(\S+)\s+-\s+(\S+)\s*\z", r"(>=|<=|>|<|=|\^|~>?)?\s*([^\s<>=^~]+)"
    pair = lambda op, text: F.struct(op.alias("op"), text.alias("text"))
    dashed = F.array(pair(F.lit(">="), F.regexp_extract(range_, between, 1)), pair(F.lit("<="), F.regexp_extract(range_, between, 2)))
    found = F.zip_with(F.regexp_extract_all(range_, F.lit(token), 1), F.regexp_extract_all(range_, F.lit(token), 2), pair)
    tokens = F.when(range_.rlike(between), dashed).when(F.size(found) > 0, found).otherwise(F.array(pair(F.lit(""), F.lit(""))))

    def of(c: Column) -> Column:
        one = _interval(F.array_max(F.transform(c, lambda x: x["low"])), F.array_min(F.transform(c, lambda x: x["high"])), bases=F.filter(F.transform(c, lambda x: x["base"]), lambda b: b.isNotNull()))
        return F.when(~F.exists(c, lambda x: x.isNull()), one)

    return _let(F.transform(tokens, _npm_comparator), of)


def intervals(specifier: Column, ecosystem: Column) -> Column:
    """The intervals of a specifier; null for none, an invalid one, or one of npm that names no registry version: the latest is then meant."""
    said = _strip(F.coalesce(specifier, F.lit("")))
    npm = _let(F.transform(F.split(said, r"\|\|"), _npm_range), lambda r: F.when(~F.exists(r, lambda x: x.isNull()), F.filter(r, lambda i: i["low"] < i["high"])))
    elsewhere = names.non_registry_specifier(said)
    none = F.lit(None).cast(f"array<{INTERVAL}>")
    return F.when(said.isin("", "*", "latest"), none).when(ecosystem == "npm", F.when(~elsewhere, npm)).otherwise(_pypi_intervals(said))


def inside(o: Column, version: Column, i: Column) -> Column:
    """Whether a version with :func:`order` ``o`` lies in the interval ``i``."""
    base = i["bases"].isNull() | ~o["pre"] | F.coalesce(F.array_contains(i["bases"], o["base"]), F.lit(False))
    return (o["key"] >= i["low"]) & (o["key"] < i["high"]) & ~(i["no_local"] & o["local"]) & ~(i["no_pre"] & o["pre"]) & base & F.coalesce(i["exact"] == version, F.lit(True))


def _looked_up(rows: DataFrame, text: str, name: str, of: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with ``name``, what ``of`` says of ``text`` and the ecosystem; each text is read once, however many rows have it.

    The texts are cut off, or filters on ``name`` would go down to the rows and compute it for each of them.
    """
    texts = cut(rows.select("ecosystem", text).distinct().withColumn(name, of(F.col(text), F.col("ecosystem"))))
    return rows.join(texts, ["ecosystem", text], "left")


def ordered(registry: DataFrame) -> DataFrame:
    """``registry`` (ecosystem, name, version, latest) with ``o``, the :func:`order` of its versions, dealt by package."""
    known = _looked_up(registry.select("ecosystem", "name", "version", "latest"), "version", "o", order)
    return known.repartition("ecosystem", "name")


def resolve(specs: DataFrame, registry: DataFrame) -> DataFrame:
    """``specs`` (ecosystem, name, specifier, …) with the version each resolves to. ``registry``: ecosystem, name, version, latest (the tag, may be null).

    The highest version inside; of Python versions a stable one if there is any, else a pre-release. Where no range is given the tag, or
    else the highest stable version. Each specifier of a package is resolved once, however many ask it. What asks one registry again and
    again gives the :func:`ordered` one.
    """
    key = ["ecosystem", "name"]
    known = registry if "o" in registry.columns else ordered(registry)
    best = lambda stable: F.max(F.when(F.col("o").isNotNull(), F.struct(stable.alias("stable"), F.col("o.key").alias("key"), F.col("version").alias("version"))))["version"]
    newest = known.groupBy(*key).agg(F.coalesce(F.max("latest"), best(~F.col("o.pre"))).alias("_latest"))
    asked = _looked_up(specs.select(*key, "specifier").distinct(), "specifier", "_ranges", intervals)
    ranged = asked.where("_ranges IS NOT NULL").select(*key, "specifier", F.explode("_ranges").alias("i"))
    hits = ranged.join(known, key).where(inside(F.col("o"), F.col("version"), F.col("i"))).groupBy(*key, "specifier").agg(best(~F.col("o.pre") | (F.col("ecosystem") == "npm")).alias("_found"))
    out = asked.join(newest, key, "left").join(hits, [*key, "specifier"], "left")
    out = out.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("specifier").alias("_specifier"), F.when(F.col("_ranges").isNull(), F.col("_latest")).otherwise(F.col("_found")).alias("version"))
    same = (F.col("ecosystem") == F.col("_ecosystem")) & (F.col("name") == F.col("_name")) & F.col("specifier").eqNullSafe(F.col("_specifier"))
    return specs.hint("merge").join(out, same, "left").drop("_ecosystem", "_name", "_specifier")
