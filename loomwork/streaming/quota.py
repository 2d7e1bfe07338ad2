"""Quota state of deployments from a stream of events: token buckets, day counters, cool-downs and circuit breakers.

Events are keyed by the quota group, so a group and its deployments change together without locks. An event is
``reserve`` (a call asks for room), ``settle`` (a call ended) or ``reap`` (leases that ran out are given up); each gives
one answer row. Late or repeated settlements find no lease and change nothing. The same step serves batches
(``replayed``) and streams (``decided``); state is one JSON text per group.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwork.operators.scale import folded

EVENT = ("group string, seq long, at double, kind string, deployment string, lease long, tin long, tout long, low boolean, outcome string, retry_after double, latency double")
ANSWER = "group string, seq long, ok boolean, lease long, wait double, reason string"
RESERVE, LEASE_S = 0.2, 300.0
RATE_LIMITED = ("rate_limited_minute", "rate_limited_day", "rate_limited_unknown")
INFINITE = float("inf")


def local_day(at: float, zone: str) -> tuple[str, float]:
    """The local date and the seconds until the next one."""
    z = ZoneInfo(zone)
    day = datetime.fromtimestamp(at, z).date()
    after = day + timedelta(days=1)
    return day.isoformat(), datetime(after.year, after.month, after.day, tzinfo=z).timestamp() - at


class Quota:
    """State of one group; ``limits`` has rpm, tpm, rpd, tpd and concurrency of the group ("") and of its deployments."""

    def __init__(self, limits: dict, zone: str = "UTC", margin: float = 0.85, day_margin: float = 0.95, state: str | None = None):
        self.limits, self.zone, self.margin, self.day_margin = limits, zone, margin, day_margin
        self.s = json.loads(state) if state else {"scopes": {}, "leases": {}, "next": 1}

    def caps(self, name: str) -> tuple:
        lim, scale = self.limits.get(name, {}), self.s["scopes"][name]["scale"]
        rpm, tpm, rpd, tpd = (lim.get(k) for k in ("rpm", "tpm", "rpd", "tpd"))
        return (None if rpm is None else max(1.0, rpm * self.margin * scale), None if tpm is None else tpm * self.margin * scale,
                *(None if x is None else max(1, int(x * self.day_margin)) for x in (rpd, tpd)))

    def touched(self, name: str, at: float) -> dict:
        """A scope with its buckets refilled up to now and its day counters of today."""
        new = {"rpm": None, "tpm": None, "at": at, "day": None, "rpd": 0, "tpd": 0, "inflight": 0, "scale": 1.0, "cool": 0.0, "circuit": "closed",
               "failures": 0, "limited": 0, "trips": 0, "success": 1.0, "valid": 1.0, "latency": None}
        s = self.s["scopes"].setdefault(name, new)
        dt = max(0.0, at - s["at"])
        for kind, cap in zip(("rpm", "tpm"), self.caps(name), strict=False):
            if cap is not None:
                s[kind] = cap if s[kind] is None else min(cap, s[kind] + cap / 60 * dt)
        s["at"] = at
        day = local_day(at, self.zone)[0]
        if s["day"] != day:
            s["day"], s["rpd"], s["tpd"] = day, 0, 0
        return s

    def reserve(self, name: str, at: float, tin: int, tout: int, low: bool) -> tuple:
        """(ok, lease, wait, reason): a lease, or the longest of the waits that stand against it."""
        scopes = [("group", "", self.touched("", at)), ("deployment", name, self.touched(name, at))]
        own, basis, spare = scopes[1][2], tin + tout, RESERVE if low else 0.0
        if own["circuit"] == "open" and own["cool"] <= at:
            own["circuit"] = "half_open"
        waits = [(s["cool"] - at, f"{label}_cooldown") for label, _, s in scopes if s["cool"] > at]
        if own["circuit"] == "half_open" and own["inflight"] > 0:
            waits.append((1.0, "probing"))
        left = local_day(at, self.zone)[1]
        for label, key, s in scopes:
            rpm, tpm, rpd, tpd = self.caps(key)
            if tpm is not None and basis > tpm or tpd is not None and basis > tpd:
                return False, None, INFINITE, "too_large"
            for kind, cap, need in (("rpm", rpm, 1.0), ("tpm", tpm, basis)):
                if cap is not None and s[kind] < need + spare * cap:
                    waits.append(((need + spare * cap - s[kind]) / (cap / 60), f"{label}_{kind}"))
            for kind, cap, need in (("rpd", rpd, 1), ("tpd", tpd, basis)):
                if cap is not None and s[kind] + need > int(cap * (1 - spare)):
                    waits.append((left, f"{label}_{kind}"))
            most = self.limits.get(key, {}).get("concurrency")
            if most is not None and s["inflight"] >= most:
                waits.append((1.0, f"{label}_concurrency"))
        if waits:
            return False, None, *max(waits, key=lambda w: w[0])  # of equal waits the first
        for _, key, s in scopes:
            rpm, tpm, _, _ = self.caps(key)
            s["rpm"] = s["rpm"] - 1 if rpm is not None else s["rpm"]
            s["tpm"] = s["tpm"] - basis if tpm is not None else s["tpm"]
            s["rpd"], s["tpd"], s["inflight"] = s["rpd"] + 1, s["tpd"] + basis, s["inflight"] + 1
        lease = self.s["next"]
        self.s["next"] += 1
        self.s["leases"][str(lease)] = {"d": name, "basis": basis, "until": at + LEASE_S}
        return True, lease, 0.0, ""

    def settle(self, lease: int, at: float, outcome: str, tin: int, tout: int, retry_after: float | None, latency: float | None,
               scope: str = "deployment") -> tuple:
        held = self.s["leases"].pop(str(lease), None)
        if held is None:
            return False, lease, 0.0, "no_lease"
        every, own = self.touched("", at), self.touched(held["d"], at)
        back = held["basis"] - (tin + tout) if outcome == "ok" else 0
        for key, s in (("", every), (held["d"], own)):
            s["inflight"] = max(0, s["inflight"] - 1)
            tpm = self.caps(key)[1]
            if tpm is not None and back:
                s["tpm"] = max(0.0, min(tpm, s["tpm"] + back))
            s["tpd"] = max(0, s["tpd"] - back)
        if outcome == "ok":
            own["trips"] = 0 if own["circuit"] == "half_open" else own["trips"]
            own["circuit"] = "closed" if own["circuit"] == "half_open" else own["circuit"]
            own["failures"] = own["limited"] = 0
            own["success"] = 0.9 * own["success"] + 0.1
            if latency is not None:
                own["latency"] = latency if own["latency"] is None else 0.8 * own["latency"] + 0.2 * latency
            for s in (every, own):
                s["scale"] = min(1.0, s["scale"] + 0.05)
        elif outcome in RATE_LIMITED:
            hit = every if scope == "group" else own
            hit["scale"] = max(0.3, hit["scale"] * 0.85)
            if outcome == "rate_limited_minute":
                hit["limited"], wait = 0, 30.0 if retry_after is None else retry_after
            elif outcome == "rate_limited_day":
                wait = local_day(at, self.zone)[1] + 30.0
            else:
                hit["limited"] += 1
                wait = max(min(600.0, 30.0 * 2 ** (hit["limited"] - 1)), retry_after or 0.0)
            hit["cool"] = max(hit["cool"], at + wait)
            for kind in ("rpm", "tpm"):
                hit[kind] = None if hit[kind] is None else 0.0
        elif outcome in ("server_error", "timeout", "network_error"):
            own["failures"] += 1
            own["success"] *= 0.9
            if own["circuit"] == "half_open" or own["failures"] >= 3:
                own["trips"] += 1
                own["circuit"], own["cool"] = "open", max(own["cool"], at + min(600.0, 15.0 * 2 ** (own["trips"] - 1)))
        elif outcome == "invalid_output":
            own["valid"] *= 0.95
        return True, lease, 0.0, outcome

    def reap(self, at: float) -> tuple:
        gone = [k for k, v in self.s["leases"].items() if v["until"] <= at]
        for k in gone:
            name = self.s["leases"].pop(k)["d"]
            for key in ("", name):
                self.s["scopes"][key]["inflight"] = max(0, self.s["scopes"][key]["inflight"] - 1)
        return True, None, float(len(gone)), "reaped"

    def step(self, e: dict) -> tuple:
        if e["kind"] == "reserve":
            return self.reserve(e["deployment"], e["at"], int(e["tin"]), int(e["tout"]), bool(e["low"]))
        if e["kind"] == "settle":
            known = lambda x: None if pd.isna(x) else float(x)
            return self.settle(int(e["lease"]), e["at"], e["outcome"], int(e["tin"]), int(e["tout"]), known(e["retry_after"]), known(e["latency"]))
        return self.reap(e["at"])


def answered(group: str, quota: Quota, rows: pd.DataFrame) -> pd.DataFrame:
    out = [(group, e["seq"], *quota.step(e)) for e in rows.sort_values("seq").to_dict("records")]
    return pd.DataFrame(out, columns=["group", "seq", "ok", "lease", "wait", "reason"]).astype({"lease": "Int64"})


def replayed(events: DataFrame, limits: dict[str, dict], zone: str = "UTC") -> DataFrame:
    """Answers to a finished log of events; a group's events pass one task in their order, with the quota as its state."""

    def step(quota: Quota, e: tuple) -> tuple[Quota, tuple]:
        return quota, (e.group, e.seq, *quota.step(e._asdict()))

    return folded(events, "group", ["seq"], lambda _: Quota(limits, zone), step, ANSWER)


def decided(events: DataFrame, limits: dict[str, dict], zone: str = "UTC") -> DataFrame:
    """Answers to a stream of events; the state of a group is kept between batches."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        quota = Quota(limits, zone, state=state.get[0] if state.exists else None)
        out = answered(key[0], quota, pd.concat(list(parts)))
        state.update((json.dumps(quota.s),))
        yield out

    return events.groupBy("group").applyInPandasWithState(run, ANSWER, "state string", "append", GroupStateTimeout.NoTimeout)
