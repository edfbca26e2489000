"""Verdicts as a stream whose state is a package's history.

Install candidates and records of past audits come as one stream, keyed by package. A package's state holds its accepted
baselines with their surfaces and the worst of what was blocked, so an event costs its own package's state and no look at any journal. Events of
one package in one micro-batch are taken in the order of seq: the second already sees what the first has written. The state
says what a candidate is compared with and what is to be written; status, reasons and summary are columns over that. What is
written goes to a file sink, so a batch that is replayed after a failure is written once.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C
from ..operators import verdict
from ..sources import settings

#: Blocked encounters of each version that a package's state keeps: a version can be forgotten, and these are then still the worst of the others.
KEPT_BLOCKED = 5
EVENT = (
    "op string, seq long, ecosystem string, name string, version string, target_hash string, profile string, status string, score int, critical boolean, "
    "role_typical_share double, accept_new boolean, surfaces array<string>"
)
_FOUND = (
    "seq long, ecosystem string, name string, version string, target_hash string, profile string, score int, critical boolean, role_typical_share double, accept_new boolean, "
    "base_version string, base_hash string, base_profile string, base_seq long, novel array<string>, prior string"
)


_COLUMNS = [f.split()[0] for f in _FOUND.split(", ")]
#: What the state needs of an event, seq first.
_READ = ("seq", "op", "version", "target_hash", "profile", "status", "score", "critical", "role_typical_share", "accept_new", "surfaces")
_Event = namedtuple("_Event", _READ)


def _worst(blocked: list) -> tuple:
    return -blocked[0], blocked[1]


class History:
    """What is known of one package."""

    def __init__(self, said: str | None = None):
        self.good, self.blocked = json.loads(said) if said else ({}, [])

    def said(self) -> str:
        return json.dumps([self.good, self.blocked])

    def baseline(self, version: str | None) -> dict | None:
        """The accepted entry of the version, else the newest of any."""
        same = self.good.get(version or "")
        return same or max(self.good.values(), key=lambda e: e["seq"], default=None)

    def prior(self) -> str | None:
        return ", ".join(f"{v or '?'} ({s}, share={round(share * 100)}%)" for share, _, v, s in sorted(self.blocked, key=_worst)[:KEPT_BLOCKED]) or None

    def record(self, seq: int, version: str | None, target_hash: str | None, profile: str | None, status: str, share: float, surfaces: list[str]) -> None:
        if status == "accepted":
            known = self.good.get(version or "")
            if known is None or known["seq"] < seq:
                self.good[version or ""] = {"seq": seq, "version": version, "hash": target_hash, "profile": profile, "surfaces": sorted(surfaces)}
        else:
            own = sorted([*(b for b in self.blocked if b[2] == version), [share, seq, version, status]], key=_worst)
            self.blocked = [b for b in self.blocked if b[2] != version] + own[:KEPT_BLOCKED]

    def forget(self, version: str | None) -> None:
        self.good.pop(version or "", None)
        self.blocked = [b for b in self.blocked if b[2] != version]


def _value(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA else x


def _judge(min_score: int, auto_score: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history, out = History(state.get[0] if state.exists else None), []
        # plain lists: a group has few rows, and what pandas does for each group would cost more than all of its events
        events = [e for batch in batches for e in zip(*(batch[c].tolist() for c in _READ))]
        for e in map(_Event._make, sorted(events, key=lambda e: e[0])):
            version, share, surfaces = _value(e.version), _value(e.role_typical_share) or 0.0, list(e.surfaces) if e.surfaces is not None else []
            if e.op == "forget":
                history.forget(version)
                continue
            if e.op == "record":
                history.record(e.seq, version, e.target_hash, _value(e.profile), _value(e.status) or "accepted", share, surfaces)
                continue
            base, score = history.baseline(version), int(_value(e.score) or 0)
            before = set(base["surfaces"]) if base else set()
            novel = sorted({s.split(":", 1)[0] for s in surfaces if s not in before} & set(C.HIGH_RISK_KINDS)) if base else []
            critical, accept = bool(_value(e.critical)), bool(_value(e.accept_new))
            said = (e.seq, *key, version, e.target_hash, _value(e.profile), score, critical, share, accept)
            out.append((*said, *((base["version"], base["hash"], base["profile"], base["seq"]) if base else (None, None, None, None)), novel, history.prior()))
            if base is None:
                if score < min_score:
                    history.record(e.seq, version, e.target_hash, _value(e.profile), "blocked-role-typical" if share >= C.ROLE_TYPICAL_THRESHOLD and not critical else "blocked-suspicious", share, surfaces)
                elif accept or score >= auto_score:
                    history.record(e.seq, version, e.target_hash, _value(e.profile), "accepted", share, surfaces)
        state.update((history.said(),))
        if out:
            found = dict(zip(_COLUMNS, zip(*out)))
            yield pd.DataFrame(found | {"base_seq": pd.array(found["base_seq"], "Int64"), "score": np.array(found["score"], np.int32)})

    return run


def judged(events: DataFrame) -> DataFrame:
    """Verdicts (see :func:`verdict.verdicts`, with seq and base_seq) of the candidates among ``events``, a stream in the shape of ``EVENT``.

    op is ``candidate``, ``record`` (an audit of the past, with its status) or ``forget`` (of a version). surfaces: signatures of findings, which
    begin with their kind and a colon. Null scores count as 0.
    """
    spark = events.sparkSession
    low, high = settings.min_score(spark), settings.auto_accept_score(spark)
    found = events.groupBy("ecosystem", "name").applyInPandasWithState(_judge(low, high), _FOUND, "history string", "append", GroupStateTimeout.NoTimeout)
    base = F.when(F.col("base_seq").isNotNull(), F.struct(F.lit("accepted").alias("status"), F.col("base_hash").alias("target_hash"), F.col("base_profile").alias("profile")))
    return verdict.verdicts(found.withColumn("baseline", base), low, high).drop("baseline")


def run(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Judge all events that are there and append the verdicts to the Parquet files below ``path``, each once."""
    return judged(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
