"""Leases of a quota group on a stream: who may call, with which credential, and what happens to calls that never end.

A group's state is typed and keyed: a scope per deployment and one for the group, a lease per running call, a row per
credential. An event reads and writes the two scopes and the one lease that it concerns, not the whole group. A lease that
is not settled in time ends by a timer at its expiry, which frees its place and gives an ``expire`` row; tokens stay spent.
An event first ends the leases that ran out before it, so answers do not depend on where batches are cut.

Calls take the active credential that was used longest ago. An ``auth_error`` quarantines the credential of its lease; a
group without an active one answers ``no_credential``, an infinite wait that beats all others. A settlement without a lease
(unknown, repeated or too late) changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomwork.streaming.quota import EVENT, INFINITE, Quota

#: Events with the scope that a rate limit names, ``group`` or ``deployment``, and a timestamp for the watermark.
CALL = EVENT + ", scope string, ts timestamp"
ANSWER = "group string, seq long, kind string, ok boolean, lease long, credential string, wait double, reason string"
SCOPE = ("rpm double, tpm double, at double, day string, rpd long, tpd long, inflight long, scale double, cool double, circuit string, "
         "failures long, limited long, trips long, success double, valid double, latency double")
LEASE = "deployment string, credential string, basis long, until double"
CREDENTIAL = "status string, used double"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class Leases(StatefulProcessor):
    """``limits`` by scope as for ``Quota``, of each group; ``credentials`` are the ids of each group's keys."""

    def __init__(self, limits: Mapping[str, Mapping[str, dict]], credentials: Mapping[str, list[str]], zone: str = "UTC"):
        self.limits, self.keys, self.zone = limits, credentials, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scopes = handle.getMapState("scopes", "scope string", SCOPE)
        self.leases = handle.getMapState("leases", "lease long", LEASE)
        self.credentials = handle.getMapState("credentials", "credential string", CREDENTIAL)
        self.next = handle.getValueState("next", "lease long")

    def close(self) -> None:
        pass

    def loaded(self, group: str, *deployments: str) -> Quota:
        quota = Quota(self.limits.get(group, {}), self.zone)
        for name in ("", *deployments):
            if self.scopes.containsKey((name,)):
                quota.s["scopes"][name] = dict(zip(names(SCOPE), self.scopes.getValue((name,)), strict=True))
        return quota

    def kept(self, quota: Quota) -> None:
        for name, s in quota.s["scopes"].items():
            self.scopes.updateValue((name,), tuple(s[k] for k in names(SCOPE)))

    def active(self, group: str) -> list[tuple[float, str]]:
        """Active credentials by when they were used last."""
        found = []
        for c in self.keys.get(group, []):
            status, used = self.credentials.getValue((c,)) if self.credentials.containsKey((c,)) else ("active", -INFINITE)
            if status == "active":
                found.append((used, c))
        return sorted(found)

    def expired(self, group: str, at: float) -> list[tuple]:
        gone = sorted((v[3], k[0], v[0], v[1]) for k, v in self.leases.iterator() if v[3] <= at)
        if gone:
            quota = self.loaded(group, *{d for _, _, d, _ in gone})
            for _, lease, deployment, _ in gone:
                self.leases.removeKey((lease,))
                for name in ("", deployment):
                    s = quota.s["scopes"][name]
                    s["inflight"] = max(0, s["inflight"] - 1)
            self.kept(quota)
        return [(group, None, "expire", True, lease, credential, 0.0, "expired") for _, lease, _, credential in gone]

    def reserve(self, group: str, e: dict) -> tuple:
        active = self.active(group)
        quota = self.loaded(group, e["deployment"])
        if not active:
            for name in ("", e["deployment"]):
                quota.touched(name, e["at"])
            self.kept(quota)
            return False, None, None, INFINITE, "no_credential"
        quota.s["next"] = self.next.get()[0] if self.next.exists() else 1
        ok, lease, wait, reason = quota.reserve(e["deployment"], e["at"], int(e["tin"]), int(e["tout"]), bool(e["low"]))
        self.kept(quota)
        if not ok:
            return False, None, None, wait, reason
        credential = active[0][1]
        self.credentials.updateValue((credential,), ("active", e["at"]))
        self.next.update((quota.s["next"],))
        held = quota.s["leases"][str(lease)]
        self.leases.updateValue((lease,), (held["d"], credential, held["basis"], held["until"]))
        self.handle.registerTimer(int(held["until"] * 1000))
        return True, lease, credential, wait, reason

    def settle(self, group: str, e: dict) -> tuple:
        lease = int(e["lease"])
        if not self.leases.containsKey((lease,)):
            return False, lease, None, 0.0, "no_lease"
        deployment, credential, basis, until = self.leases.getValue((lease,))
        quota = self.loaded(group, deployment)
        quota.s["leases"][str(lease)] = {"d": deployment, "basis": basis, "until": until}
        known = lambda x: None if pd.isna(x) else float(x)
        ok, _, wait, reason = quota.settle(lease, e["at"], e["outcome"], int(e["tin"]), int(e["tout"]), known(e["retry_after"]), known(e["latency"]), e["scope"] or "deployment")
        self.leases.removeKey((lease,))
        if e["outcome"] == "auth_error":
            self.credentials.updateValue((credential,), ("quarantined", e["at"]))
        self.kept(quota)
        return ok, lease, credential, wait, reason

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "seq"])
        out = []
        for e in events.to_dict("records"):
            out += self.expired(key[0], e["at"])
            answer = self.reserve(key[0], e) if e["kind"] == "reserve" else self.settle(key[0], e)
            out.append((key[0], e["seq"], e["kind"], *answer))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.frame(self.expired(key[0], expiredTimerInfo.getExpiryTimeInMs() / 1000))

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names(ANSWER)).astype({"seq": "Int64", "lease": "Int64", "ok": "boolean", "wait": "float64"})


def timed(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Events of ``quota.EVENT`` (and perhaps ``scope``) as ``CALL``, with a watermark."""
    scope = F.col("scope") if "scope" in events.columns else F.lit(None).cast("string")
    rows = events.withColumns({"scope": scope, "ts": F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))})
    return rows.select(*names(CALL)).withWatermark("ts", late)


def leased(events: DataFrame, limits: Mapping[str, Mapping[str, dict]], credentials: Mapping[str, list[str]], zone: str = "UTC") -> DataFrame:
    """Answers to a stream of ``CALL`` events, and the leases that ran out; needs the RocksDB state store (``STORE``, ``ROCKS``)."""
    return timed(events).groupBy("group").transformWithStateInPandas(Leases(limits, credentials, zone), ANSWER, "Append", "EventTime")
