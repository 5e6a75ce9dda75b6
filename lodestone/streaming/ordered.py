"""Stateful jobs over streams whose rows come in any order: rows wait until the watermark has passed them, then they are walked
by time and id. The walk itself is a plain object, which batch jobs use as well, so a stream and a batch give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LATE = "10 minutes"
#: Events of one value of a state's list. A value costs a call of its own on both sides, an event in it next to nothing.
TOGETHER = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for stateful streams: their store is RocksDB, and the caller's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


class Purchase:
    """One purchase's state: a step that isn't allowed from it is rejected."""

    STEPS = {None: ("quoted",), "quoted": ("paid", "failed"), "paid": ("delivered", "refunded"), "failed": (), "delivered": ("refunded",), "refunded": ()}
    EVENT = "us long, id long, status string"
    ROW = "key long, status string, rejected long, steps long"
    STATE = "status string, rejected long, steps long"

    def __init__(self, saved: tuple | None = None, known=None):
        self.status, self.rejected, self.steps = saved or (None, 0, 0)

    def saved(self) -> tuple:
        return self.status, self.rejected, self.steps

    def walk(self, key: int, events: list[tuple], until: int) -> list[tuple]:
        """The state after these events (us, id, status); without events nothing."""
        for _, _, status in events:
            self.steps += 1
            if status in self.STEPS[self.status]:
                self.status = status
            else:
                self.rejected += 1
        return [(key, self.status, self.rejected, self.steps)] if events else []

    def waits_for(self) -> int | None:
        return None


class Payments:
    """One payer's quotes and payments. A payment is for the payer's last quote and has one reason: paid, or unknown (no quote
    yet), used (the quote is paid), expired, underpaid, reused (the transaction has paid before). A quote that isn't paid ends
    as unpaid, or as replaced by the next one; that row has no payment."""

    EVENT = "us long, id long, kind string, amount double, txid string"
    ROW = "key long, quote_id long, payment_id long, reason string"
    STATE = "quote_id long, price double, at long, status string"
    TTL = 600 * 60_000_000

    def __init__(self, saved: tuple | None = None, known=None):
        self.quote, self.price, self.at, self.status = saved or (None, 0.0, 0, "none")
        self.known = set() if known is None else known

    def saved(self) -> tuple:
        return self.quote, self.price, self.at, self.status

    def ended(self, key: int, now: int) -> list[tuple]:
        if self.status == "open" and now > self.at + self.TTL:
            self.status = "expired"
            return [(key, self.quote, None, "unpaid")]
        return []

    def walk(self, key: int, events: list[tuple], until: int) -> list[tuple]:
        """Rows of these events (us, id, kind, amount, txid), and of a quote whose time ends before `until`."""
        out = []
        for us, i, kind, amount, txid in events:
            out += self.ended(key, us)
            if kind == "quote":
                if self.status == "open":
                    out.append((key, self.quote, None, "replaced"))
                self.quote, self.price, self.at, self.status = i, amount, us, "open"
                continue
            if self.status == "none":
                reason = "unknown"
            elif self.status in ("paid", "expired"):
                reason = "used" if self.status == "paid" else "expired"
            elif amount < self.price:
                reason = "underpaid"
            elif txid is not None and txid in self.known:
                reason = "reused"
            else:
                reason, self.status = "paid", "paid"
                if txid is not None:
                    self.known.add(txid)
            out.append((key, self.quote, i, reason))
        return out + self.ended(key, until)

    def waits_for(self) -> int | None:
        """When an open quote's time ends."""
        return self.at + self.TTL if self.status == "open" else None


class KnownTransactions:
    """A payer's paid transactions in a stream's state, as the walk asks for them."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, txid: str) -> bool:
        return self.state.containsKey((txid,))

    def add(self, txid: str) -> None:
        self.state.updateValue((txid,), (1,))


class InOrder(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then walks them by time and id. Events are held in lists, a
    list a column, of at most TOGETHER."""

    def __init__(self, kind: type):
        self.kind = kind

    def init(self, handle) -> None:
        self.handle = handle
        self.names, types = zip(*(c.split() for c in self.kind.EVENT.split(", ")))
        self.held = handle.getListState("held", ", ".join(f"{n} array<{t}>" for n, t in zip(self.names, types)))
        self.state = handle.getValueState("state", self.kind.STATE)
        self.known = KnownTransactions(handle.getMapState("known", "txid string", "one int"))

    @staticmethod
    def values(column: pd.Series) -> list:
        """Plain values, None where there is none."""
        found = column.tolist()
        return [None if x != x else x for x in found] if column.hasnans else found

    def lists(self, events: list[tuple]) -> list[tuple]:
        """Events (tuples of the kind's columns) as values of the list state."""
        return [tuple(map(list, zip(*events[k : k + TOGETHER]))) for k in range(0, len(events), TOGETHER)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            events = list(zip(*(self.values(some[n]) for n in self.names)))
            for value in self.lists(events):
                self.held.appendValue(value)
            self.handle.registerTimer(min(e[0] for e in events) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        held = sorted((e for x in self.held.get() for e in zip(*x)), key=lambda e: e[:2]) if self.held.exists() else []
        ready = [e for e in held if e[0] // 1000 < until]
        rest = held[len(ready) :]
        if ready and rest:
            self.held.put(self.lists(rest))
        elif ready:
            self.held.clear()
        if rest:  # the watermark may stand at the very millisecond of the timer that brought us here
            self.handle.registerTimer(max(rest[0][0] // 1000, until + 1 if rest[0][0] // 1000 == until else 0))
        own = self.kind(self.state.get() if self.state.exists() else None, self.known)
        out = own.walk(int(key[0]), ready, until * 1000)
        self.state.update(own.saved())
        if (at := own.waits_for()) is not None:
            self.handle.registerTimer(at // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.kind.ROW.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def walked_stream(events: DataFrame, kind: type, late: str = LATE) -> DataFrame:
    """Rows of a kind of walk over a stream of events (key, ts, id and what the kind asks for) in any order, in append mode.

    An event counts once the watermark, `late` behind the newest, has passed it; events that come later than that are
    dropped (streaming.late keeps them). Equal times go by id. The result doesn't depend on files, batches or order. A
    key's events between two watermarks are in memory together."""
    names = [c.split()[0] for c in kind.EVENT.split(", ")]
    rows = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).select("key", "ts", *names)
    return rows.groupBy("key").transformWithStateInPandas(InOrder(kind), kind.ROW, "Append", "EventTime")


def walked_batch(events: DataFrame, kind: type, until: DataFrame | None = None) -> DataFrame:
    """The same rows for a table of events: each task walks its sorted keys one after another, with one key's state.

    until: one row with the milliseconds (column until) before which events count; all where there is none. A null key is
    a key, a null time comes first, no events give no rows. `Purchase` gives a row a key, the last."""
    names = [c.split()[0] for c in kind.EVENT.split(", ")]
    far = F.lit((1 << 62) // 1000)
    rows = events.withColumn("us", F.coalesce(F.unix_micros("ts"), F.lit(0)))
    rows = rows.crossJoin(F.broadcast(until)) if until is not None else rows.withColumn("until", far)
    rows = rows.filter(F.floor(F.col("us") / 1000) < F.col("until")).select("key", "until", *names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, end = None, None, 0
        for b in batches:
            out: list[tuple] = []
            for key, limit, *event in zip(*(b.column(c).to_pylist() for c in ("key", "until", *names))):
                if own is None or key != at:
                    if own is not None:
                        out += own.walk(at, [], end * 1000)
                    own, at, end = kind(), key, limit
                out += own.walk(key, [tuple(event)], event[0])
            yield batch(out)
        if own is not None:
            yield batch(own.walk(at, [], end * 1000))

    columns = [c.split() for c in kind.ROW.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def batch(out: list[tuple]) -> pa.RecordBatch:
        values = list(zip(*out)) or [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(values, columns)], [c for c, _ in columns])

    found = rows.repartition("key").sortWithinPartitions("key", "us", "id").mapInArrow(walk, kind.ROW)
    if kind is Purchase:
        return found.groupBy("key").agg(F.max(F.struct("steps", "status", "rejected")).alias("last")).select("key", "last.status", "last.rejected", "last.steps")
    return found


def watermark(events: DataFrame, late: Callable = lambda newest: newest - F.expr("INTERVAL 10 MINUTES")) -> DataFrame:
    """One row: the milliseconds (until) that a stream of these events has passed at its end."""
    return events.agg(F.unix_millis(late(F.max("ts"))).alias("until"))
