"""Hour ledgers and leases as keyed state with timers on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sedimenta.session import fresh_dir

#: The policy of an hour.
NORMAL, RESERVE, ENVELOPE = 3000, 500, 3500
OUTCOMES = ("consumed", "not_sent", "uncertain")
LOG = "hour timestamp, at timestamp, request long, command string, refused string, normal long, reserve long, frozen boolean"
CHANGES = "worker long, at timestamp, state string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Arbitrary state needs the RocksDB store; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that has arrived, appending to Parquet at `out`, and read that. Run again, it goes on where it stopped."""
    spark = stream.sparkSession
    with state_store(spark):
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def once(stream: DataFrame, tag: str) -> DataFrame:
    """run_available() in fresh folders of the application."""
    at = fresh_dir(stream.sparkSession, tag)
    return run_available(stream, f"{at}/out", f"{at}/checkpoint")


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


class HourLedger(StatefulProcessor):
    """One clock hour: what its lanes have committed, its reservations, and whether it is frozen."""

    def __init__(self, normal: int = NORMAL, reserve: int = RESERVE, envelope: int = ENVELOPE) -> None:
        self.limits, self.envelope = {"normal": normal, "reserve": reserve}, envelope

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "normal long, reserve long, frozen boolean")
        self.requests = handle.getMapState("requests", "request long", "lane string, outcome string")

    def _known(self, request: int) -> tuple[str, str | None] | None:
        """A request's lane and outcome. An hour without state asks the state for nothing, any other one once a request and batch."""
        if request not in self.known:
            stored = not self.fresh and self.requests.containsKey((request,))
            self.known[request] = self.requests.getValue((request,)) if stored else None
        return self.known[request]

    def _settle(self, request: int, lane: str, outcome: str | None) -> None:
        self.known[request] = (lane, outcome)
        self.changed.add(request)

    def decide(self, row: tuple, used: dict, frozen: bool) -> tuple[str | None, bool]:
        """Why a command is refused, null if it isn't, and whether the hour is frozen after it; used is changed."""
        request, command, lane, inside = row
        known = self._known(request)
        if command == "reserve":
            if frozen:
                return "frozen", frozen
            if known is not None:
                return "duplicate", frozen
            if lane not in self.limits:
                return "unknown_lane", frozen
            if not inside:
                return "outside_hour", frozen
            if sum(used.values()) >= self.envelope:
                return "envelope_exhausted", frozen
            if used[lane] >= self.limits[lane]:
                return f"{lane}_exhausted", frozen
            used[lane] += 1
            self._settle(request, lane, None)
            return None, frozen
        if known is None:
            return "unknown_request", frozen
        if known[1] is not None:
            return "already_settled", frozen
        if command not in OUTCOMES:
            return "unknown_outcome", frozen
        if command == "not_sent":
            used[known[0]] -= 1
        self._settle(request, known[0], command)
        return None, frozen or command == "uncertain"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.fresh, self.known, self.changed = not self.used.exists(), {}, set()
        normal, reserve, frozen = (0, 0, False) if self.fresh else self.used.get()
        used, hour, after = {"normal": normal, "reserve": reserve}, pd.Timestamp(key[0]), []
        commands = _in_order(rows, ["at", "request", "rank"])
        inside = (commands["at"] >= hour) & (commands["at"] < hour + timedelta(hours=1))
        for row in zip(commands["request"], commands["command"], commands["lane"], inside, strict=True):
            refused, frozen = self.decide(row, used, frozen)
            after.append((refused, used["normal"], used["reserve"], frozen))
        for request in self.changed:
            self.requests.updateValue((request,), self.known[request])
        self.used.update((used["normal"], used["reserve"], frozen))
        log = commands[["at", "request", "command"]].reset_index(drop=True)
        log.insert(0, "hour", hour)
        yield log.join(pd.DataFrame(after, columns=["refused", "normal", "reserve", "frozen"]))

    def close(self) -> None:
        pass


def hour_ledger(commands: DataFrame, normal: int = NORMAL, reserve: int = RESERVE, envelope: int = ENVELOPE) -> DataFrame:
    """A stream of commands (hour, at, request, command, lane, rank) to a log: each with why it was refused, and the hour after it.

    command: reserve, or the outcome of a reservation: consumed, not_sent (gives its place back) or uncertain, which
    freezes the hour: no more reservations. A reservation is refused, in this order, as frozen, duplicate, unknown_lane,
    outside_hour (late or early), envelope_exhausted or <lane>_exhausted; an outcome as unknown_request, already_settled
    or unknown_outcome. Commands that arrive together are taken by (at, request, rank). An hour is one key: its decisions
    depend on all before.
    """
    return commands.groupBy("hour").transformWithStateInPandas(HourLedger(normal, reserve, envelope), LOG, "Append", "None")


class Leases(StatefulProcessor):
    """One worker: its last beat. Silence is told by timers, without a beat that ends it."""

    def __init__(self, degraded_s: int, expired_s: int) -> None:
        self.after = (("degraded", degraded_s), ("expired", expired_s))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long, told long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, told = self.last.get() if self.last.exists() else (None, len(self.after))
        out = []
        for beat in sorted(int(at.timestamp() * 1000) for frame in rows for at in frame["at"]):
            if last is not None and beat <= last:
                continue  # a beat that repeats or comes out of order extends nothing
            if last is not None:
                while told < len(self.after) and last + self.after[told][1] * 1000 < beat:
                    out.append((key[0], last + self.after[told][1] * 1000, self.after[told][0]))
                    told += 1
            if last is None or told:
                out.append((key[0], beat, "online"))
            last, told = beat, 0
        self.last.update((last, told))
        self._arm(last, told)
        yield self._rows(out)

    def _arm(self, last: int, told: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if told < len(self.after):
            self.handle.registerTimer(last + self.after[told][1] * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, told = self.last.get()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        while told < len(self.after) and last + self.after[told][1] * 1000 <= now:
            out.append((key[0], last + self.after[told][1] * 1000, self.after[told][0]))
            told += 1
        if told < len(self.after):
            self.last.update((last, told))
            self.handle.registerTimer(last + self.after[told][1] * 1000)
        else:
            self.last.clear()  # the lease is gone, and so is its state
        yield self._rows(out)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(k, datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None), s) for k, ms, s in out], columns=["worker", "at", "state"])

    def close(self) -> None:
        pass


def lease_changes(beats: DataFrame, degraded_s: int = 300, expired_s: int = 3600, late: str = "0 seconds") -> DataFrame:
    """A stream of beats (worker, at) to changes (worker, at, state): online at a beat, degraded and expired after silence (T4).

    Silence ends where the next beat stands, or, without one, where the watermark has come to: a timer tells it then. An
    expired worker's state is dropped, so state grows with the workers that are alive. Beats that repeat or come out of
    order within a batch extend nothing; those behind the watermark are dropped.
    """
    return beats.withWatermark("at", late).groupBy("worker").transformWithStateInPandas(Leases(degraded_s, expired_s), CHANGES, "Append", "EventTime")
