"""URL rules and link-graph propagation.

A page is judged by the longest rule that fits its host and path. Pages that no rule fits are judged
by their host: personalised PageRank carries trust from allowed seeds along the links between hosts,
and distrust from blocked seeds against them; a host is blocked if its distrust outweighs its trust
and an even share among the hosts that are reached.

Edges are the absolute and protocol-relative links of the pages' HTML, counted per pair of hosts, and
an edge both ways between a host and the domain above it. All of it is joins and sums over hosts:
partial sums run before each shuffle, the pages' HTML is read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialize, table

#: (host, path, verdict); fixed by the contract.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
DAMPING = 0.85
#: Steps at least; more follow until what is left to move is under ``SMALL`` of the threshold of one host.
ITERATIONS = 8
SMALL = 0.01
#: A host is blocked if its distrust is over its trust and over so many times an even share (1 / hosts that are reached).
THRESHOLD = 0.5
#: Steps between two looks at what has changed; steps in one job where ranks are a table of a join.
STEPS_A_LOOK, STEPS_A_JOB = 4, 2
#: The ranks of so many hosts at most are broadcast (about 10 MB), a step in a job, and are written in so many parts.
FEW_HOSTS, FEW_PARTS = 100_000, 8
PARENT_WEIGHT = 1.0
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]*)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ``://`` up to ``/?#``, and then up to ``?#``; both empty without ``://``."""
    known = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(known, "://") > 0, F.substr(known, F.instr(known, "://") + 3)).otherwise("")
    return _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judged_by_rule(df: DataFrame, rules=RULES, host: str = "host", path: str = "path") -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits; rules are a short fixed list."""
    fits = lambda r: ((F.col(host) == r[0]) | F.col(host).endswith(f".{r[0]}")) & F.col(path).startswith(r[1])
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        rule, verdict = F.when(fits(r), r[0] + r[1]).otherwise(rule), F.when(fits(r), r[2]).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(src, dst, weight) between different hosts; ``pages`` has ``host`` already."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html_column, F.lit("")), F.lit(LINK), 1)).alias("link"))
    links = links.select("src", split_url(F.concat(F.lit("x:"), F.regexp_replace("link", r"^[^/]*(?=//)", "")))[0].alias("dst"))
    return links.where("src != dst AND src != '' AND dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def parent_edges(hosts: DataFrame, weight: float) -> DataFrame:
    """An edge both ways between each host of two labels or more and the domain above it."""
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = hosts.select(F.explode(F.arrays_zip(F.slice(chain, 1, F.size(labels) - 1).alias("a"), F.slice(chain, 2, F.size(labels) - 1).alias("b"))).alias("e"))
    up = up.select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).where("src != '' AND dst != ''").distinct()
    return up.union(up.select("dst", "src")).withColumn("weight", F.lit(float(weight)))


def propagate(edges: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """Personalised PageRank of both kinds: (host, trust, distrust), after ``iterations`` steps or more, when converged.

    A job's steps shrink the change of the job before to ``damping`` to the power of their number, or less, which bounds the sum
    of all changes to come; steps end when that is at most ``SMALL * threshold / hosts``.

    ``seeds`` (host, trust, distrust) are the personalisation, ``edges`` (src, dst, weight). Trust moves
    from src to dst, distrust from dst to src. Each kind's seeds sum to 1; mass at hosts without a way
    on is dropped, as it says nothing about others.
    """
    both = edges.select("src", "dst", "weight", F.lit(True).alias("good")).union(edges.select(F.col("dst"), F.col("src"), F.col("weight"), F.lit(False)))
    both = both.groupBy("good", "src", "dst").agg(F.sum("weight").alias("weight"))
    # both are written, so that the joins get exchanges of their own and a host with very many links is split
    both = materialize(both, "both")
    out = materialize(both.groupBy("good", "src").agg(F.sum("weight").alias("all")), "out")
    graph = both.hint("merge").join(out, ["good", "src"]).select("good", "src", "dst", (F.col("weight") / F.col("all")).alias("part"))
    graph = materialize(graph, "graph")
    total = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    part = lambda good, c, all_: seeds.select("host", F.lit(good).alias("good"), (F.col(c) / F.lit(float(all_ or 1))).alias("p"))
    start = part(True, "trust", total.t).union(part(False, "distrust", total.d)).where("p > 0")
    start = materialize(start, "seeds")
    hosts = graph.select("src").union(graph.select("dst")).union(start.select("host")).distinct().count()
    few = hosts <= FEW_HOSTS
    # a write of few rows in few parts; a table of very many rows stays in as many as there are
    written = lambda df, tag: materialize(df.coalesce(FEW_PARTS) if few else df, tag)
    steps_a_job = 1 if few else STEPS_A_JOB
    shrinks = damping**steps_a_job
    small = SMALL * threshold / max(1, hosts) * (1 - shrinks) / shrinks

    def step(rank: DataFrame) -> DataFrame:
        # the key is an expression, so that the join has an exchange of its own on this side, too
        at = rank.select("good", F.coalesce("host", F.lit("")).alias("src"), "r")
        moved = (graph.join(F.broadcast(at), ["good", "src"]) if few else graph.hint("merge").join(at, ["good", "src"])).select(F.col("dst").alias("host"), "good", (F.col("r") * F.col("part") * damping).alias("r"))
        return moved.unionByName(start.select("host", "good", (F.col("p") * (1 - damping)).alias("r"))).groupBy("host", "good").agg(F.sum("r").alias("r"))

    rank = materialize(start.select("host", "good", F.col("p").alias("r")), "rank")
    steps = 0
    while True:
        steps += steps_a_job
        new = rank
        for _ in range(steps_a_job):  # in one job the graph shuffles once
            new = step(new)
        new = written(new, "rank")
        change = None
        if steps % STEPS_A_LOOK == 0:
            # of the last steps together, which is at least that of the very last one
            both = new.unionByName(rank.withColumn("r", -F.col("r"))).groupBy("host", "good").agg(F.sum("r").alias("d"))
            change = both.agg(F.sum(F.abs("d")).alias("d")).first().d or 0.0
        discard(rank)
        rank = new
        if change is not None and steps >= iterations and change <= small:
            break
    score = lambda good: F.coalesce(F.sum(F.when(F.col("good") == good, F.col("r"))), F.lit(0.0))
    return rank.groupBy("host").agg(score(True).alias("trust"), score(False).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, parent_weight: float = PARENT_WEIGHT, iterations: int = ITERATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict, host_trust, host_distrust for each page.

    A null url, or one without ``://``, has an empty host and path; no rule fits it and it is allowed.
    Hosts that neither kind of seed reaches are allowed. Null HTML has no links. Rows that repeat are
    judged alike; columns other than page_id, url and html are not read.
    """
    host, path = split_url(F.col("url"))
    spread = judged_by_rule(pages.select("page_id", host.alias("host"), path.alias("path"), "html"), rules)
    edges = materialize(host_edges(spread), "links")
    judged = materialize(spread.drop("html"), "judged")
    # a host's pages that rules allow or block are its seed
    count = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host != ''").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    if parent_weight:
        named = seeds.select("host").union(edges.select("dst")).distinct()
        edges = edges.union(parent_edges(named, parent_weight)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    scores = materialize(propagate(edges, seeds, iterations, threshold=threshold), "scores")
    even = threshold / max(1, scores.count())
    blocked = F.coalesce(F.col("distrust") > F.greatest(F.col("trust"), F.lit(even)), F.lit(False))
    # scores were written, so that both sides get an exchange of their own and a hot host is split
    out = judged.hint("merge").join(scores, "host", "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("host_trust"), F.coalesce("distrust", F.lit(0.0)).alias("host_distrust"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page, by :func:`judge` with the fixed rules. Null urls have an empty host and are allowed."""
    return judge(table(spark, sf_dir, "pages"))
