"""Keyed state on streams: ledgers and leases against their batch twins, over restarts."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from sedimenta.plans.ledgers import commands_of
from sedimenta.streaming.ledger import HourLedger, hour_ledger, lease_changes, once, run_available

START = datetime(2024, 3, 1)


def by_hand(commands, normal, reserve, envelope):
    """The ledger one command at a time: rows (hour, at, request, command, lane, rank)."""
    out, hours = [], {}
    for hour, at, request, command, lane, _ in sorted(commands, key=lambda c: (c[0], c[1], c[2], c[5])):
        s = hours.setdefault(hour, {"used": {"normal": 0, "reserve": 0}, "frozen": False, "known": {}})
        used, why = s["used"], None
        if command == "reserve":
            why = (
                "frozen" if s["frozen"] else "duplicate" if request in s["known"] else "unknown_lane" if lane not in used else "outside_hour" if not hour <= at < hour + timedelta(hours=1)
                else "envelope_exhausted" if sum(used.values()) >= envelope else f"{lane}_exhausted" if used[lane] >= {"normal": normal, "reserve": reserve}[lane] else None
            )
            if why is None:
                used[lane] += 1
                s["known"][request] = [lane, None]
        elif request not in s["known"]:
            why = "unknown_request"
        elif s["known"][request][1]:
            why = "already_settled"
        elif command not in ("consumed", "not_sent", "uncertain"):
            why = "unknown_outcome"
        else:
            s["known"][request][1] = command
            used[s["known"][request][0]] -= command == "not_sent"
            s["frozen"] |= command == "uncertain"
        out.append((hour, at, request, command, why, used["normal"], used["reserve"], s["frozen"]))
    return out


KINDS = "hour timestamp, at timestamp, request long, command string, lane string, rank int"


def some_commands():
    r = random.Random(8)
    rows = []
    for h in range(4):
        hour = START + timedelta(hours=24 * h)
        for i in range(120):
            at = hour + timedelta(seconds=r.randint(-30, 3700))
            rows.append((hour, at, 1000 * h + r.randint(0, 70), r.choice(["reserve", "reserve", "reserve", "consumed", "not_sent", "not_sent", "bad"] + ["uncertain"] * (h > 2)), r.choice(["normal", "normal", "reserve", "other"]), i))
    return rows


def test_hour_ledger_is_the_loop_and_goes_on_after_a_restart(spark, tmp_path):
    rows = some_commands()
    want = sorted(map(repr, by_hand(rows, 12, 6, 16)))
    assert {x[4] for x in by_hand(rows, 12, 6, 16)} >= {None, "frozen", "duplicate", "unknown_lane", "outside_hour", "envelope_exhausted", "normal_exhausted", "reserve_exhausted", "unknown_request", "already_settled", "unknown_outcome"}
    # within an hour the first half arrives before the second, in another run of the query
    rows.sort(key=lambda c: (c[0], c[1], c[2], c[5]))
    half = {h: sum(c[0] == h for c in rows) // 2 for h in {c[0] for c in rows}}
    early, seen = [], {}
    for c in rows:
        seen[c[0]] = seen.get(c[0], 0) + 1
        if seen[c[0]] <= half[c[0]]:
            early.append(c)
    source = str(tmp_path / "commands")
    write = lambda part: spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(source)
    write(early)
    stream = lambda: hour_ledger(spark.readStream.schema(KINDS).parquet(source), 12, 6, 16)
    first = run_available(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).count()
    assert first == len(early)
    write([c for c in rows if c not in early])
    got = run_available(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()
    assert sorted(repr(tuple(x)) for x in got) == want
    # nothing new: nothing more
    assert run_available(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).count() == len(rows)


class Store:
    """A value and a map as the state store has them, with a count of calls."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k],
            "updateValue": self.map.__setitem__,
        }[name]


def test_an_hours_commands_dont_ask_the_state_one_by_one():
    store, ledger = Store(), HourLedger(12, 6, 16)
    ledger.init(store)
    rows = [(START, START + timedelta(seconds=i // 2), i // 2, ["reserve", "consumed"][i % 2], "normal", i % 2) for i in range(4000)]
    run = lambda part: [r for f in ledger.handleInputRows((START,), iter([pd.DataFrame(part, columns=[k.split()[0] for k in KINDS.split(", ")])]), None) for r in f.itertuples(index=False, name=None)]
    first = run(rows[:3001])
    assert store.calls < 30
    want = by_hand(rows, 12, 6, 16)
    plain = lambda out: [(*x[:4], x[4] if isinstance(x[4], str) else None, *map(int, x[5:])) for x in out]
    assert plain(first + run(rows[3001:])) == plain(want)


def test_commands_of_events_name_their_hours(spark):
    df = spark.createDataFrame([(50, START, "error", 10.0), (51, START, "signup", 1.0)], "event_id long, ts timestamp, event_type string, value double")
    got = {(r.request, r.command): (r.hour, r.lane) for r in commands_of(df).collect()}
    assert got == {(50, "reserve"): (START + timedelta(hours=1), "normal"), (50, "uncertain"): (START + timedelta(hours=1), "normal"), (51, "reserve"): (START, "reserve"), (51, "consumed"): (START, "reserve")}


def test_leases_expire_without_a_beat(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    source = str(tmp_path / "beats")
    write = lambda rows: spark.createDataFrame([(w, at(s)) for w, s in rows], "worker long, at timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: lease_changes(spark.readStream.schema("worker long, at timestamp").parquet(source), 60, 600)
    run = lambda: {(r.worker, int((r["at"] - START).total_seconds()), r.state) for r in run_available(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()}
    write([(1, 0), (1, 30), (1, 30), (1, 200), (2, 0), (3, 700)])
    # worker 2 is silent from 0 on; the watermark is at 700 only
    assert run() == {(1, 0, "online"), (1, 90, "degraded"), (1, 200, "online"), (1, 260, "degraded"), (2, 0, "online"), (2, 60, "degraded"), (2, 600, "expired"), (3, 700, "online")}
    write([(1, 810), (3, 730), (2, 900)])
    got = run()
    assert {x for x in got if x[0] == 1} == {(1, 0, "online"), (1, 90, "degraded"), (1, 200, "online"), (1, 260, "degraded"), (1, 800, "expired"), (1, 810, "online"), (1, 870, "degraded")}
    assert {x for x in got if x[0] == 2 and x[1] > 600} == {(2, 900, "online")}
    assert {x for x in got if x[0] == 3} == {(3, 700, "online"), (3, 790, "degraded")}


@pytest.mark.parametrize("make", [lambda s: hour_ledger(s.readStream.schema(KINDS).parquet(s.conf.get("empty"))), lambda s: lease_changes(s.readStream.schema("worker long, at timestamp").parquet(s.conf.get("empty")))])
def test_streams_of_nothing(spark, tmp_path, make):
    (tmp_path / "none").mkdir()
    spark.conf.set("empty", str(tmp_path / "none"))
    assert once(make(spark), "nothing").collect() == []
