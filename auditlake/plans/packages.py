"""Journal, verdict, name, command and dependency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import closure, commands, verdict
from ..sources import cache, doctor, journal, requirements
from ..sources.scratch import cut
from . import derived as D

_GOOD = "coalesce(status, 'accepted') = 'accepted'"


def _index(spark, sf):
    return journal.index(D.journal(spark, sf))


def journal_index_upsert(spark, sf):
    return _index(spark, sf).select("ecosystem", "name", "target_hash", "seq", "version", "status")


def journal_latest_known_good(spark, sf):
    return journal.latest_known_good(_index(spark, sf)).select("ecosystem", "name", "seq", "version", "target_hash")


def journal_accepted_for_version(spark, sf):
    return journal.accepted_for_version(_index(spark, sf)).select("ecosystem", "name", "version", "seq", "target_hash")


def journal_latest_entry(spark, sf):
    return journal.latest_entry(_index(spark, sf)).select("ecosystem", "name", "seq", "status")


def journal_list_filtered(spark, sf):
    rows = journal.listed(_index(spark, sf), ecosystem="pypi", profile="plugin", status="accepted", name_like="B1")
    return journal.newest_first(rows).select("name", "version", "seq", "audited_at")


def journal_counts(spark, sf):
    return journal.counts_by(_index(spark, sf))


def journal_stats(spark, sf):
    return journal.stats(_index(spark, sf))


def journal_upper_median(spark, sf):
    return journal.upper_median(_index(spark, sf))


def journal_profile_means(spark, sf):
    return journal.profile_means(_index(spark, sf))


def blocked_review(spark, sf):
    return journal.blocked_review(_index(spark, sf)).select("group_rank", "share", "seq", "name")


def prior_blocked_top5(spark, sf):
    return journal.prior_blocked(_index(spark, sf))


def index_integrity(spark, sf):
    rows = _index(spark, sf)
    return journal.integrity(rows.where("seq % 11 <> 0"), rows.where("seq % 13 <> 0"))


def doctor_checks(spark, sf):
    rows = cut(_index(spark, sf))  # read by four checks
    reports = rows.where("seq % 13 <> 0").withColumn("schema_version", F.when(F.col("seq") % 4 != 0, 1))
    return doctor.checks(rows, reports)


def doctor_report(spark, sf):
    """How many checks of the self-test are well, and whether all are."""
    return doctor.report(doctor_checks(spark, sf))


def closure_lines(spark, sf):
    """Every tree as text, a line a node."""
    return closure.render(_tree(spark, sf))


def baseline_choice(spark, sf):
    specs = D.journal(spark, sf).where("op = 'put'").select("ecosystem", "name", "version", F.col("seq").alias("candidate"))
    out = verdict.baseline_of(specs, _index(spark, sf).select("ecosystem", "name", "version", "seq", "status"))
    return out.select("candidate", "ecosystem", "name", F.col("baseline.seq").alias("baseline_seq"))


def promote_actions(spark, sf):
    specs = D.table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "pypi").otherwise("npm").alias("ecosystem"), F.concat(F.lit("lib"), F.col("s_suppkey").cast("string")).alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("1."), (F.col("s_suppkey") % 7).cast("string"))).alias("version"))
    return journal.promote(_index(spark, sf), specs)


def promote_rows(spark, sf):
    """What promoting every version that is blocked writes to the journal."""
    rows = _index(spark, sf)
    specs = rows.where("status LIKE 'blocked%'").select("ecosystem", "name", "version").distinct()
    out = journal.promoted(rows, specs, 5_000_000, "2024-03-01T00:00:00+00:00")
    return out.select("seq", "op", "ecosystem", "name", "version", "target_hash", "status", "refreshed_at")


_CANDIDATE = """seq, ecosystem, name, version, target_hash, profile, score, role_typical_share, seq % 9 = 0 AS critical, seq % 6 = 0 AS accept_new"""


def _candidates(spark, sf):
    j = D.journal(spark, sf).where("op = 'put'")
    return j.selectExpr("seq", "ecosystem", "name", "version", "target_hash", "profile", "score", "role_typical_share", "seq % 9 = 0 AS critical", "seq % 6 = 0 AS accept_new")


def first_encounter_verdict(spark, sf):
    none = F.lit(None)
    c = _candidates(spark, sf).withColumn("baseline", none.cast("struct<status:string,target_hash:string,profile:string>")).withColumn("novel", none.cast("array<string>")).withColumn("prior", none.cast("string"))
    return verdict.verdicts(c).select("seq", "status", "write_status", F.size("reasons").alias("n_reasons"))


def re_encounter_verdict(spark, sf):
    c = _candidates(spark, sf)
    base = F.struct(F.when(F.col("seq") % 2 == 0, "accepted").alias("status"), F.when(F.col("seq") % 5 == 0, F.col("target_hash")).otherwise("other").alias("target_hash"), F.when(F.col("seq") % 4 != 3, F.col("profile")).otherwise("scraping").alias("profile"))
    novel = F.when(F.col("seq") % 7 == 0, F.array(F.lit("obfuscation"), F.lit("subprocess"))).otherwise(F.array().cast("array<string>"))
    out = verdict.verdicts(c.withColumn("baseline", base).withColumn("novel", novel).withColumn("prior", F.lit(None).cast("string")))
    return out.select("seq", "status", F.array_join("reasons", "; ").alias("reasons"))


_NAMES = ["requests", "Flask_Login", "@scope/pkg", "bad spec!", "zope.interface", "A.-_b", "-odd", "x", "@a/B", "My__Lib", "end-"]
_VERSIONS = ["", "==2.31.0", "@1.2.3", "@^1", "==", ">=1"]
_SPECIFIERS = ["", ">=1.0,<2", "[socks,x] >= 2", " (==3.1)", "[a](>1)", " ^2.0", "==1.*"]
_MARKERS = ["", "; python_version < 3", "; extra == dev", " ;extra==y and x", ";"]
#: A spec and a requirement line for each part, the same in Spark and in SQL.
_SPEC = f"concat({D.pick('p_partkey % 11', _NAMES)}, {D.pick('p_partkey % 6', _VERSIONS)})"
_REQUIREMENT = f"concat({D.pick('p_partkey % 11', _NAMES)}, {D.pick('p_partkey % 7', _SPECIFIERS)}, {D.pick('p_partkey % 5', _MARKERS)})"
_CANONICAL = "CASE WHEN starts_with({n}, '@') THEN {n} WHEN {npm} THEN lower({n}) ELSE lower(regexp_replace({n}, '[-_.]+', '-', 'g')) END"
_PYPI = "^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)(?:==(.+))?$"


def spec_parse(spark, sf):
    s = D.table(spark, sf, "part").selectExpr("p_partkey", f"{_SPEC} AS raw")
    eco = N.spec_ecosystem(F.col("raw"))
    s = s.select("p_partkey", eco.alias("ecosystem"), N.parse_spec(F.col("raw"), eco).alias("p")).select("p_partkey", "ecosystem", "p.name", "p.version")
    return s.withColumn("formatted", N.format_spec(F.col("name"), F.col("version"), F.col("ecosystem")))


def pep503_names(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("My"), F.expr(D.pick("p_partkey % 4", ["_", "-.-", "..", "__"])), F.lit("Lib"), F.col("p_partkey").cast("string")).alias("raw"))
    return p.select("p_partkey", N.canonical_name(F.col("raw"), F.lit("pypi")).alias("name"))


def requirement_parse(spark, sf):
    s = D.table(spark, sf, "part").select("p_partkey", N.parse_requirement(F.expr(_REQUIREMENT)).alias("r"))
    return s.where("r IS NOT NULL").select("p_partkey", "r.name", "r.specifier")


_VERBS = ["pip install", "pip3 install", "uv add", "UV pip install", "uvx", "pipx run", "uv tool install", "npm i", "pnpm add", "yarn add", "npx -y", "npx", "echo", "pip download"]
_FORMS = ["", "==1.2", ">=2", "@1.0", "@^2", "[extra]", ".whl"]
_FLAGS = ["", "-r reqs.txt", "--upgrade", "-e ./local", "2> out.txt"]
_TAILS = ["", " && ls -la", " ; uvx tool==1", " || yarn add @s/p@2.0 ./x"]
#: A shell line for each part, the same in Spark and in SQL.
_COMMAND = f"concat({D.pick('p_partkey % 14', _VERBS)}, ' pkg', CAST(p_partkey AS STRING), {D.pick('p_partkey % 7', _FORMS)}, ' ', {D.pick('p_partkey % 5', _FLAGS)}, ' lib_', CAST(p_partkey % 13 AS STRING), {D.pick('p_partkey % 4', _TAILS)})"
_TOOL = D.pick("p_partkey % 11", ["Bash", "PowerShell", "Read", "Bash", "PowerShell", "Edit", "Bash", "Bash", "PowerShell", "Bash", "Bash"])
_TREE = D.pick("p_partkey % 3", ["safe", "first-encounter-needs-accept", "first-encounter-accepted"])
_COMMANDS_SQL = f"""commands AS (SELECT p_partkey, {_COMMAND} AS command FROM part),
fragments AS (SELECT p_partkey, CAST(i - 1 AS INT) AS ordinal, f AS fragment FROM (SELECT p_partkey, unnest(a) AS f, generate_subscripts(a, 1) AS i FROM (SELECT p_partkey, regexp_split_to_array(command, '\\s*(?:&&|\\|\\||\\||;)\\s*') AS a FROM commands)))"""
_INSTALLS_SQL = f"""{_COMMANDS_SQL},
verbs AS (SELECT *, regexp_extract(lower(fragment), '^(uvx|pipx (?:install|run)|uv tool (?:install|run)|pip3? install|uv add|uv pip install|p?npm (?:install|i|add)|yarn add|npx -y)\\b') AS verb FROM fragments),
tails AS (SELECT *, list_filter(string_split(substr(fragment, length(verb) + 1), ' '), lambda x: x <> '') AS a FROM verbs WHERE verb <> ''),
each AS (SELECT * FROM (SELECT *, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM tails)),
placed AS (SELECT *, lag(w) OVER o AS before, coalesce(bool_or(regexp_matches(w, '^[0-9]*[<>]+&?[0-9]*$')) OVER o, false) AS over FROM each WINDOW o AS (PARTITION BY p_partkey, ordinal ORDER BY i)),
words AS (SELECT *, CASE WHEN starts_with(w, '@') THEN regexp_extract(w, '^@[^@]*') ELSE regexp_extract(w, '^[^=<>~^!@]*') END AS name FROM placed
  WHERE NOT over AND NOT starts_with(w, '-') AND (before IS NULL OR before NOT IN ('-r', '-c', '-e', '-t', '--requirement', '--constraint', '--editable', '--target'))),
installs AS (SELECT p_partkey, ordinal, verb, CASE WHEN regexp_matches(verb, '^(p?npm|yarn|npx)') THEN 'npm' ELSE 'pypi' END AS ecosystem, i,
  CASE WHEN regexp_matches(replace(substr(w, length(name) + 1), '==', ''), '[=<>~^!]') THEN name ELSE w END AS spec FROM words
  WHERE regexp_matches(name, '^(@[A-Za-z0-9._-]+/)?[A-Za-z0-9._-]+$') AND NOT regexp_matches(name, '\\.(txt|whl|tgz|tar\\.gz)$'))"""


def _commands(spark, sf):
    return D.table(spark, sf, "part").selectExpr("p_partkey", f"{_COMMAND} AS command", f"{_TOOL} AS tool")


def chained_command_split(spark, sf):
    return _commands(spark, sf).select("p_partkey", F.posexplode(commands.split_chain(F.col("command"))).alias("ordinal", "fragment"))


def install_verbs(spark, sf):
    return commands.installs(_commands(spark, sf), ("p_partkey",)).select("p_partkey", "ordinal", "ecosystem", F.array_join("specs", ",").alias("specs"), "profile_hint")


def hook_decisions(spark, sf):
    """Every part's shell line as a payload; trees are known for bare names of two thirds of the parts, all else fails closed."""
    body = F.to_json(F.struct(F.col("tool").alias("tool_name"), F.struct("command").alias("tool_input")))
    lines = _commands(spark, sf).select("p_partkey", F.when(F.col("p_partkey") % 10 == 9, "not json").otherwise(body).alias("payload"))
    asked = commands.installs(commands.payloads(lines).where("command IS NOT NULL"), ("p_partkey",))
    known = D.table(spark, sf, "part").selectExpr("explode(array('pypi', 'npm')) AS ecosystem", "concat('pkg', CAST(p_partkey AS STRING)) AS spec", f"{_TREE} AS composed_status")
    judged = commands.spec_verdicts(asked, known, ("p_partkey",))
    out = lines.select("p_partkey").join(commands.decisions(judged, ("p_partkey",)), "p_partkey", "left")
    return out.select("p_partkey", F.coalesce("exit_code", F.lit(0)).alias("exit_code"), F.coalesce("said", F.lit("")).alias("said"))


_FILE_COMMANDS = ["uv pip sync reqs.txt", "uv pip sync reqs.txt ../more.txt", "uv pip sync", "uv sync", "uv lock --project other", "uv pip sync ghost.txt", "uv sync --directory=none"]
_REQUIREMENT_TEXT = "concat('Flask>=2 # web\\n\\n-r deep/base.txt\\n-e ./here\\nlib', CAST(s_suppkey AS STRING), '; python_version > 3\\n')"
_PROJECT_TEXT = "concat('[project]\\nname = \"a\"\\ndependencies = [\"numpy>=2\", \"lib', CAST(s_suppkey AS STRING), '\"]\\n[project.optional-dependencies]\\ngpu = [\"Torch\", \"NumPy\"]\\n[dependency-groups]\\ndev = [\"pytest\", {include-group = \"x\"}]\\n')"


def hook_file_installs(spark, sf):
    """Commands that install what requirement files (with what they include) and projects declare, for each supplier's folder."""
    s = D.table(spark, sf, "supplier").withColumn("home", F.concat(F.lit("/w/s"), F.col("s_suppkey").cast("string")))
    file = lambda path, text: s.select(F.concat("home", F.lit(path)).alias("path"), F.expr(text).alias("text"))
    files = file("/a/reqs.txt", _REQUIREMENT_TEXT).union(file("/a/deep/base.txt", "'requests==1\\n-r ../../more.txt\\n'")).union(file("/more.txt", "'FLASK\\n-r a/reqs.txt\\nattrs\\n'"))
    files = files.union(file("/pyproject.toml", _PROJECT_TEXT)).union(file("/a/other/pyproject.toml", "CASE WHEN s_suppkey % 2 = 0 THEN '[project' ELSE '[project]\\ndependencies = [\"only\"]' END"))
    asked = commands.installs(s.select("s_suppkey", F.concat("home", F.lit("/a")).alias("cwd"), F.expr(D.pick("s_suppkey % 7", _FILE_COMMANDS)).alias("command")), ("s_suppkey",))
    asked = asked.join(s.select("s_suppkey", F.concat("home", F.lit("/a")).alias("cwd")), "s_suppkey")
    out = requirements.from_files(asked, files, ("s_suppkey",))
    return out.select("s_suppkey", "profile_reason", F.array_join("specs", ",").alias("specs"), F.col("block_reason").isNotNull().alias("blocked"))


def dependency_closure(spark, sf):
    roots = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return closure.closure(roots, D.edges(spark, sf).select("parent", "child"))


def _named_edges(spark, sf):
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias(c)
    return D.edges(spark, sf).select(name("parent"), "ordinal", name("child"))


def _tree(spark, sf):
    s = D.table(spark, sf, "supplier")
    name = F.concat(F.lit("p"), F.col("s_suppkey").cast("string"))
    roots = s.select(name.alias("node"))
    status = s.select(name.alias("node"), F.when(F.col("s_suppkey") % 23 == 0, "drift").when(F.col("s_suppkey") % 3 == 0, "first-encounter-accepted").otherwise("safe").alias("status"))
    return closure.tree(roots, _named_edges(spark, sf), status)


def closure_tree(spark, sf):
    return _tree(spark, sf).select("root", "path", "node", "depth", "cycle", "truncated")


def closure_status(spark, sf):
    return closure.composed_status(_tree(spark, sf))


def closure_accept(spark, sf):
    return closure.accept_closure(_tree(spark, sf)).select("root", "refused", F.size("pending").alias("n_pending"))


def cache_prune_candidates(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", F.col("ts").alias("modified"), F.floor("value").cast("long").alias("size"))
    return cache.candidates(e, F.to_timestamp(F.lit("2024-02-10 00:00:00")), 30).select("event_id", "size")


def cache_prune_totals(spark, sf):
    return cache.totals(cache_prune_candidates(spark, sf))


def _of(rows, columns, modulus, select=None):
    names = ", ".join(columns)
    return f"SELECT {select or 's_suppkey, ' + names} FROM supplier JOIN (SELECT * FROM {D.values(rows, 't(r, ' + names + ')')}) t ON s_suppkey % {modulus} = r"


_I = f"WITH {D.INDEX_SQL} "
_LATEST = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY seq DESC) AS r FROM idx{w}"
_BAND = "CASE WHEN score IS NULL THEN 'unscored' WHEN score >= 90 THEN 'high' WHEN score >= 50 THEN 'mid' ELSE 'low' END"
_MEDIAN = "(SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM idx WHERE score IS NOT NULL) WHERE r = n // 2 + 1)"
_SC = f"WITH {D.JOURNAL_SQL}, c AS (SELECT {_CANDIDATE}, coalesce(score, 0) AS s FROM journal WHERE op = 'put') "
_CLOSURE = f"""WITH RECURSIVE e AS ({D.EDGES}), c AS (SELECT s_suppkey AS root, s_suppkey AS node, 0 AS depth FROM supplier
  UNION SELECT c.root, CAST(e.child AS BIGINT), c.depth + 1 FROM c JOIN e ON c.node = e.parent WHERE c.depth < 5) SELECT root, node, min(depth) AS depth FROM c GROUP BY ALL"""

QUERIES = {
    "journal_index_upsert": (journal_index_upsert, _I + "SELECT ecosystem, name, target_hash, seq, version, status FROM idx"),
    "journal_latest_known_good": (journal_latest_known_good, _I + f"SELECT ecosystem, name, seq, version, target_hash FROM ({_LATEST.format(k='ecosystem, name', w=' WHERE ' + _GOOD)}) WHERE r = 1"),
    "journal_accepted_for_version": (journal_accepted_for_version, _I + f"SELECT ecosystem, name, version, seq, target_hash FROM ({_LATEST.format(k='ecosystem, name, version', w=' WHERE ' + _GOOD)}) WHERE r = 1"),
    "journal_latest_entry": (journal_latest_entry, _I + f"SELECT ecosystem, name, seq, status FROM ({_LATEST.format(k='ecosystem, name', w='')}) WHERE r = 1"),
    "journal_list_filtered": (journal_list_filtered, _I + f"SELECT name, version, seq, audited_at FROM idx WHERE ecosystem = 'pypi' AND coalesce(profile, 'plugin') = 'plugin' AND {_GOOD} AND lower(name) LIKE '%b1%'"),
    "journal_counts": (journal_counts, _I + f"SELECT 'ecosystem' AS dimension, ecosystem AS value, count(*) AS n FROM idx GROUP BY ecosystem UNION ALL SELECT 'profile', coalesce(profile, 'unknown'), count(*) FROM idx GROUP BY 2 UNION ALL SELECT 'band', {_BAND}, count(*) FROM idx GROUP BY 2"),
    "journal_stats": (journal_stats, _I + f"""SELECT count(*) AS total, avg(score) AS mean_score, {_MEDIAN} AS median_score, count(*) FILTER (score >= 90) AS high, count(*) FILTER (score >= 50 AND score < 90) AS mid,
      count(*) FILTER (score < 50) AS low, count(*) FILTER (score IS NULL) AS unscored, (SELECT seq FROM idx WHERE audited_at IS NOT NULL ORDER BY audited_at, seq LIMIT 1) AS oldest_seq, (SELECT seq FROM idx WHERE audited_at IS NOT NULL ORDER BY audited_at DESC, seq DESC LIMIT 1) AS newest_seq FROM idx"""),
    "journal_upper_median": (journal_upper_median, _I + f"SELECT {_MEDIAN} AS median_score"),
    "journal_profile_means": (journal_profile_means, _I + "SELECT coalesce(profile, 'unknown') AS profile, round_even(avg(score), 1) AS mean_score, count(*) AS n FROM idx WHERE score IS NOT NULL GROUP BY 1"),
    "blocked_review": (blocked_review, _I + "SELECT CASE WHEN status = 'blocked-role-typical' THEN 1 ELSE 2 END AS group_rank, coalesce(role_typical_share, 0.0) AS share, seq, name FROM idx WHERE status LIKE 'blocked%'"),
    "prior_blocked_top5": (prior_blocked_top5, _I + f""", b AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY role_typical_share DESC, seq) AS r, count(*) OVER (PARTITION BY ecosystem, name) AS n FROM idx WHERE NOT {_GOOD})
      SELECT ecosystem, name, n, string_agg(version || ' (' || status || ', share=' || CAST(round_even(role_typical_share * 100, 0) AS INT) || '%)', ', ' ORDER BY r) AS prior FROM b WHERE r <= 5 GROUP BY ALL""".replace(" , b AS", ", b AS")),
    "index_integrity": (index_integrity, _I + "SELECT ecosystem, name, target_hash, CASE WHEN seq % 13 = 0 THEN 'missing' ELSE 'orphan' END AS problem FROM idx WHERE (seq % 13 = 0) <> (seq % 11 = 0)"),
    "doctor_checks": (doctor_checks, _I + """SELECT 1 AS ordinal, 'library' AS name, 'ok' AS status, count(*) || ' entries' AS detail FROM idx
      UNION ALL SELECT 2, 'index', 'fail', count(*) FILTER (seq % 13 = 0) || ' missing, 0 orphan: ' || array_to_string((list_sort(list(ecosystem || '/' || name || '/' || target_hash) FILTER (seq % 13 = 0)))[1:3], '; ') FROM idx
      UNION ALL SELECT 3, 'schema', 'warn', count(*) FILTER (seq % 4 = 0) || ' of ' || count(*) || ' stale' FROM idx WHERE seq % 13 <> 0
      UNION ALL SELECT 4, 'profiles', 'warn', string_agg(p || '=' || n, ', ' ORDER BY p) FROM (SELECT coalesce(profile, '<unset>') AS p, count(*) AS n FROM idx GROUP BY 1)"""),
    "doctor_report": (doctor_report, _I + """SELECT 1::BIGINT AS ok, 2::BIGINT AS warn, 1::BIGINT AS fail, false AS healthy FROM idx HAVING count(*) FILTER (seq % 13 = 0) > 0 AND count(*) FILTER (seq % 4 = 0 AND seq % 13 <> 0) > 0 AND count(*) FILTER (profile IS NULL) > 0"""),
    "closure_lines": (closure_lines, None),
    "baseline_choice": (baseline_choice, _I + f""", s AS (SELECT seq AS candidate, ecosystem, name, version FROM journal WHERE op = 'put'), a AS (SELECT * FROM idx WHERE {_GOOD})
      SELECT candidate, s.ecosystem, s.name, coalesce((SELECT max(seq) FROM a WHERE a.ecosystem = s.ecosystem AND a.name = s.name AND a.version = s.version), (SELECT max(seq) FROM a WHERE a.ecosystem = s.ecosystem AND a.name = s.name)) AS baseline_seq FROM s"""),
    "promote_actions": (promote_actions, _I + f""", s AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, 'lib' || s_suppkey AS name, CASE WHEN s_suppkey % 3 <> 0 THEN '1.' || (s_suppkey % 7) END AS version FROM supplier),
      l AS (SELECT ecosystem, name, version, seq, status FROM ({_LATEST.format(k='ecosystem, name, version', w='')}) WHERE r = 1)
      SELECT s.ecosystem, s.name, s.version, CASE WHEN s.version IS NULL THEN 'no-version' WHEN l.seq IS NULL THEN 'missing' WHEN coalesce(status, 'accepted') = 'accepted' THEN 'no-op' ELSE 'promote' END AS action,
        CASE WHEN s.version IS NULL THEN 2 WHEN l.seq IS NULL THEN 1 ELSE 0 END AS exit_code FROM s LEFT JOIN l USING (ecosystem, name, version)"""),
    "promote_rows": (promote_rows, _I + f""", l AS (SELECT * FROM ({_LATEST.format(k='ecosystem, name, version', w='')}) WHERE r = 1 AND coalesce(status, 'accepted') <> 'accepted')
      SELECT row_number() OVER (ORDER BY ecosystem, name, version, target_hash) + 4999999 AS seq, 'put' AS op, ecosystem, name, version, target_hash, 'accepted' AS status, '2024-03-01T00:00:00+00:00' AS refreshed_at FROM l"""),
    "first_encounter_verdict": (first_encounter_verdict, _SC + """SELECT seq, CASE WHEN s < 50 THEN 'low-score' WHEN accept_new OR s >= 90 THEN 'first-encounter-accepted' ELSE 'first-encounter-needs-accept' END AS status,
      CASE WHEN s < 50 THEN CASE WHEN critical OR role_typical_share < 0.8 THEN 'blocked-suspicious' ELSE 'blocked-role-typical' END WHEN accept_new OR s >= 90 THEN 'accepted' END AS write_status,
      CASE WHEN s < 50 THEN 3 ELSE 2 END AS n_reasons FROM c"""),
    "re_encounter_verdict": (re_encounter_verdict, _SC + """, r AS (SELECT seq, CASE WHEN s < 50 AND NOT (seq % 2 = 0 AND seq % 5 = 0) THEN 'score ' || s || ' below threshold 50' END AS a, CASE WHEN seq % 7 = 0 THEN 'novel high-risk surfaces vs. baseline: obfuscation, subprocess' END AS b,
      CASE WHEN seq % 4 = 3 AND coalesce(profile, 'plugin') <> 'scraping' THEN 'profile changed: scraping -> ' || coalesce(profile, 'plugin') END AS d FROM c)
      SELECT seq, CASE WHEN concat_ws('', a, b, d) = '' THEN 'safe' ELSE 'drift' END AS status, concat_ws('; ', a, b, d) AS reasons FROM r""".replace(" , r AS", ", r AS")),
    "spec_parse": (spec_parse, f"""WITH p AS (SELECT p_partkey, {_SPEC} AS raw FROM part), e AS (SELECT *, starts_with(raw, '@') AS npm FROM p),
      n AS (SELECT p_partkey, npm, CASE WHEN npm THEN regexp_extract(raw, '^@[^@]*') ELSE nullif(regexp_extract(raw, '{_PYPI}', 1), '') END AS name,
        CASE WHEN npm THEN CASE WHEN instr(substr(raw, 2), '@') > 0 THEN regexp_extract(raw, '^@[^@]*@(.*)$', 1) END ELSE nullif(regexp_extract(raw, '{_PYPI}', 2), '') END AS version FROM e),
      c AS (SELECT p_partkey, npm, {_CANONICAL.format(n="name", npm="npm")} AS name, version FROM n)
      SELECT p_partkey, CASE WHEN npm THEN 'npm' ELSE 'pypi' END AS ecosystem, name, version, CASE WHEN coalesce(version, '') = '' THEN name ELSE name || CASE WHEN npm THEN '@' ELSE '==' END || version END AS formatted FROM c"""),
    "pep503_names": (pep503_names, "SELECT p_partkey, lower(regexp_replace('My' || " + D.pick("p_partkey % 4", ["_", "-.-", "..", "__"]) + " || 'Lib' || p_partkey, '[-_.]+', '-', 'g')) AS name FROM part"),
    "requirement_parse": (requirement_parse, f"""WITH p AS (SELECT p_partkey, {_REQUIREMENT} AS t FROM part), b AS (SELECT p_partkey, trim(split_part(t, ';', 1)) AS body, CASE WHEN instr(t, ';') > 0 THEN substr(t, instr(t, ';') + 1) ELSE '' END AS marker FROM p),
      n AS (SELECT *, regexp_extract(body, '^@?[A-Za-z0-9][A-Za-z0-9._/-]*') AS raw FROM b WHERE NOT (contains(marker, 'extra') AND contains(marker, '=='))),
      r AS (SELECT p_partkey, raw, trim(regexp_replace(trim(substr(body, length(raw) + 1)), '^\\[[^\\]]*\\]', '')) AS rest FROM n WHERE raw <> '')
      SELECT p_partkey, {_CANONICAL.format(n="raw", npm="false")} AS name, nullif(CASE WHEN starts_with(rest, '(') AND ends_with(rest, ')') THEN trim(rest[2:-2]) ELSE rest END, '') AS specifier FROM r"""),
    "chained_command_split": (chained_command_split, f"WITH {_COMMANDS_SQL} SELECT * FROM fragments"),
    "install_verbs": (install_verbs, f"""WITH {_INSTALLS_SQL} SELECT p_partkey, ordinal, ecosystem, string_agg(spec, ',' ORDER BY i) AS specs,
      CASE WHEN regexp_matches(verb, '^(uvx|pipx|uv tool|npx)') THEN 'mcp-server' END AS profile_hint FROM installs GROUP BY p_partkey, ordinal, ecosystem, verb"""),
    "hook_decisions": (hook_decisions, f"""WITH {_INSTALLS_SQL}, trees AS (SELECT 'pkg' || p_partkey AS spec, {_TREE} AS status FROM part),
      judged AS (SELECT DISTINCT p_partkey, ordinal, spec || ' (' || ecosystem || '): ' || coalesce(status, 'preflight-error') AS what FROM installs LEFT JOIN trees USING (spec) WHERE coalesce(status, 'x') NOT IN ('safe', 'first-encounter-accepted')),
      said AS (SELECT p_partkey, string_agg(what, '; ' ORDER BY ordinal, what) AS said FROM judged JOIN (SELECT p_partkey FROM part WHERE {_TOOL} IN ('Bash', 'PowerShell') AND p_partkey % 10 <> 9) USING (p_partkey) GROUP BY p_partkey)
      SELECT p_partkey, CASE WHEN said IS NULL THEN 0 ELSE 2 END AS exit_code, coalesce(said, '') AS said FROM part LEFT JOIN said USING (p_partkey)"""),
    "hook_file_installs": (hook_file_installs, """SELECT s_suppkey, 'install-verb: ' || CASE s_suppkey % 7 WHEN 3 THEN 'uv sync' WHEN 4 THEN 'uv lock' WHEN 6 THEN 'uv sync' ELSE 'uv pip sync' END AS profile_reason,
      CASE s_suppkey % 7 WHEN 0 THEN 'Flask,requests,attrs,lib' || s_suppkey WHEN 1 THEN 'Flask,requests,attrs,lib' || s_suppkey WHEN 3 THEN 'numpy,lib' || s_suppkey || ',Torch,pytest' WHEN 4 THEN CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'only' END ELSE '' END AS specs,
      s_suppkey % 7 IN (2, 5, 6) OR (s_suppkey % 7 = 4 AND s_suppkey % 2 = 0) AS blocked FROM supplier"""),
    "dependency_closure": (dependency_closure, _CLOSURE),
    "closure_tree": (closure_tree, None),
    "closure_status": (closure_status, None),
    "closure_accept": (closure_accept, None),
    "cache_prune_candidates": (cache_prune_candidates, "SELECT event_id, CAST(floor(value) AS BIGINT) AS size FROM events WHERE epoch(TIMESTAMP '2024-02-10 00:00:00') - floor(epoch(ts)) >= 30 * 86400"),
    "cache_prune_totals": (cache_prune_totals, "SELECT count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS bytes_freed FROM events WHERE epoch(TIMESTAMP '2024-02-10 00:00:00') - floor(epoch(ts)) >= 30 * 86400"),
}
