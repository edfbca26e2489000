"""The verdict stream against a loop over all events in their order."""

import random

from pyspark.sql import functions as F

from auditlake.functions import constants as C
from auditlake.streaming import verdicts


def events(r, first, n):
    kinds = ["subprocess:a", "subprocess:b", "outbound_network:h", "hardcoded_host:h", "obfuscation:x:1"]
    out = []
    for seq in range(first, first + n):
        op = r.choice(["candidate"] * 6 + ["record", "forget"])
        out.append((op, seq, r.choice(["pypi", "npm"]), r.choice(["a", "b", "c"]), r.choice(["1", "2", None]), f"h{r.randrange(4)}", r.choice([None, "plugin", "scraping"]), r.choice([None, "accepted", "blocked-suspicious"]), r.choice([None, 10, 60, 95, 100]),
                    r.choice([True, False, None]), r.choice([None, 0.5, 0.9, 0.25]), r.choice([None, False, False, True]), r.sample(kinds, r.randrange(4))))
    return out


def by_hand(rows):
    """(seq, status, base_seq, novel, prior, write_status) of each candidate."""
    out, history = [], {}
    for op, seq, eco, name, version, digest, profile, status, score, critical, share, accept, surfaces in sorted(rows, key=lambda x: x[1]):
        h = history.setdefault((eco, name), [])
        share, score = share or 0.0, score or 0
        if op == "forget":
            h[:] = [x for x in h if x["version"] != version]
            continue
        entry = {"seq": seq, "version": version, "hash": digest, "profile": profile, "surfaces": surfaces, "share": share}
        if op == "record":
            h.append(entry | {"status": status or "accepted"})
            continue
        good = [x for x in h if x["status"] == "accepted"]
        base = max([x for x in good if x["version"] == version] or good, key=lambda x: x["seq"], default=None)
        bad = sorted((x for x in h if x["status"] != "accepted"), key=lambda x: (-x["share"], x["seq"]))[:5]
        prior = ", ".join(f"{x['version'] or '?'} ({x['status']}, share={round(x['share'] * 100)}%)" for x in bad) or None
        novel, write = [], None
        if base:
            novel = sorted({s.split(":")[0] for s in surfaces if s not in base["surfaces"]} & set(C.HIGH_RISK_KINDS))
            forgiven = base["hash"] == digest
            drifts = (score < 50 and not forgiven) or novel or (base["profile"] or "plugin") != (profile or "plugin")
            said = "drift" if drifts else "safe"
        elif score < 50:
            said, write = "low-score", "blocked-suspicious" if critical or share < 0.8 else "blocked-role-typical"
        elif accept or score >= 90:
            said, write = "first-encounter-accepted", "accepted"
        else:
            said = "first-encounter-needs-accept"
        if write:
            h.append(entry | {"status": write})
        out.append((seq, said, base and base["seq"], novel, prior, write))
    return out


def test_stream_restarts_and_keeps_its_state(spark, tmp_path):
    r = random.Random(7)
    source, sink, state = (str(tmp_path / n) for n in ("source", "sink", "state"))
    save = lambda rows: spark.createDataFrame(rows, verdicts.EVENT).coalesce(1).write.mode("append").parquet(source)
    got = lambda: sorted((x.seq, x.status, x.base_seq, list(x.novel), x.prior, x.write_status) for x in spark.read.parquet(sink).collect())
    stream = lambda: spark.readStream.schema(verdicts.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    all_ = []
    for turn in range(2):
        # two files, so two batches of one run; the second turn begins again from the checkpoint
        for part in range(2):
            more = events(r, 1 + 40 * (2 * turn + part), 40)
            all_ += more
            save(more)
        verdicts.run(stream(), sink, state).awaitTermination()
        expected = by_hand(all_)
        assert got() == expected and len({x[1] for x in expected}) >= 4 and any(x[2] is not None and x[2] > 40 for x in expected)
    # nothing new: nothing is written again
    verdicts.run(stream(), sink, state).awaitTermination()
    assert got() == by_hand(all_)
    summary = spark.read.parquet(sink).where("status = 'drift'").select("summary").first().summary
    assert "drift" in summary and spark.read.parquet(sink).where(F.col("blocked") != F.col("status").isin("low-score", "drift", "first-encounter-needs-accept")).isEmpty()


def test_events_of_a_table(spark, tmp_path):
    from datetime import datetime

    from auditlake.plans import registry, trees

    r = random.Random(2)
    rows = [(i, datetime(2024, 1, 1), r.randrange(6), r.choice(["click", "view", "purchase", "signup"]), float(r.randrange(130))) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    names = [f.split()[0] for f in verdicts.EVENT.split(", ")]
    expected = by_hand([tuple(x[n] for n in names) for x in trees.as_events(df).collect()])
    got = registry.queries()["stream_verdicts"](spark, str(tmp_path)).collect()
    assert sorted((x.seq, x.status, x.base_seq, x.novel.split(",") if x.novel else [], x.prior, x.write_status) for x in got) == expected and len(expected) > 200


def test_a_group_without_candidates_makes_no_rows():
    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            self.said = value[0]

    names = [f.split()[0] for f in verdicts.EVENT.split(", ")]
    record = lambda seq, status: ("record", seq, "pypi", "a", "1", f"h{seq}", None, status, 90, False, 0.5, False, ["subprocess:a"])
    batches = [pd.DataFrame([record(2, "accepted"), record(1, "accepted")], columns=names), pd.DataFrame([record(3, "blocked-suspicious")], columns=names)]
    state = State()
    assert list(verdicts._judge(50, 80)(("pypi", "a"), iter(batches), state)) == []
    history = verdicts.History(state.said)
    assert history.baseline("1")["seq"] == 2 and history.prior() == "1 (blocked-suspicious, share=50%)"
