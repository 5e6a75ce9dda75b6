import random
from datetime import datetime, timedelta
from itertools import permutations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.streaming import late, live, ordered

START = datetime(2024, 1, 1)


def replay(spark, rows, schema, parts, folder):
    """Rows as a stream of files that are read in the order of parts (a number for each row)."""
    frame = spark.createDataFrame([(*r, p) for r, p in zip(rows, parts)], f"{schema}, part int")
    return late.replayed(frame, F.col("part"), str(folder))


def last_state(rows):
    return {(r.key, r.status, r.rejected, r.steps) for r in rows.collect()}


CHANGES = [(7, s, START + timedelta(hours=k), k) for k, s in enumerate(["quoted", "paid", "delivered", "refunded"])]


def test_held_events_are_few_values(spark):
    """A state's list has a value for many events, not one for each; they come back as they were, nulls as well."""
    own = ordered.InOrder(ordered.Payments)
    n = 2 * ordered.TOGETHER + 5
    events = [(k, -k, "quote" if k % 2 else None, None if k % 3 else k / 2, str(k)) for k in range(n)]
    values = own.lists(events)
    assert len(values) == 3 and [e for v in values for e in zip(*v)] == events
    assert own.lists([]) == []
    assert own.values(pd.Series([1.5, None])) == [1.5, None] and own.values(pd.Series(["a", None])) == ["a", None]


LATER = (99, "quoted", START + timedelta(days=9), 100)  # moves the watermark on


@pytest.mark.parametrize("batch_rows", ["2", "10000"])
def test_purchase_states_in_any_order_and_batch_size(spark, tmp_path, batch_rows):
    own = ordered.stateful_session(spark)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    schema = "key long, status string, ts timestamp, id long"
    for parts in ([3, 2, 1, 0], [0, 0, 0, 0], [0, 1, 0, 1]):
        rows = [*reversed(CHANGES), LATER]
        stream = replay(own, rows, schema, [*parts, 9], tmp_path)
        states = live.drained(ordered.walked_stream(stream, ordered.Purchase, "9 days"), "append", ["key"], str(tmp_path), "steps")
        assert last_state(states) == set()  # nothing has passed yet
        stream = replay(own, [*rows, (99, "x", START + timedelta(days=20), 101)], schema, [*parts, 9, 10], tmp_path)
        states = live.drained(ordered.walked_stream(stream, ordered.Purchase, "9 days"), "append", ["key"], str(tmp_path), "steps")
        assert last_state(states) == {(7, "refunded", 0, 4), (99, "quoted", 0, 1)}


def test_ties_go_by_id(spark):
    rows = [(1, s, START, i) for i, s in enumerate(["quoted", "paid", "delivered"])]
    for order in permutations(rows):
        frame = spark.createDataFrame(list(order), "key long, status string, ts timestamp, id long")
        assert last_state(ordered.walked_batch(frame, ordered.Purchase)) == {(1, "delivered", 0, 3)}
    assert ordered.walked_batch(frame.limit(0), ordered.Purchase).count() == 0


def test_arriving_changes_are_sorted_across_arrow_batches(spark, tmp_path):
    spark.createDataFrame([(k, s, t, i) for k, s, t, i in reversed(CHANGES)], "key long, status string, ts timestamp, change_id long").coalesce(1).write.parquet(f"{tmp_path}/c.parquet")
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    r = live.drained(live.purchase_states(live.event_stream(own, f"{tmp_path}/c.parquet")), "update", ["key"], str(tmp_path)).first()
    assert (r.status, r.rejected) == ("refunded", 0)


def slow_settled(events, until):
    """Plain version: every question asked anew of all that came before."""
    out = []
    for key in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == key and e[1] < until), key=lambda e: (e[1], e[2]))
        paid: dict[int, tuple] = {}
        for n, (_, ts, i, kind, amount, txid) in enumerate(own):
            quotes = [e for e in own[: n + 1] if e[3] == "quote"]
            if kind == "payment":
                if not quotes:
                    reason, q = "unknown", None
                else:
                    _, at, q, _, price, _ = quotes[-1]
                    if q in paid:
                        reason = "used"
                    elif ts > at + timedelta(minutes=600):
                        reason = "expired"
                    elif amount < price:
                        reason = "underpaid"
                    elif txid is not None and txid in {t for _, t in paid.values()}:
                        reason = "reused"
                    else:
                        reason, paid[q] = "paid", (i, txid)
                out.append((key, q, i, reason))
        quotes = [e for e in own if e[3] == "quote"]
        for k, (_, at, q, *_) in enumerate(quotes):
            if q not in paid:
                ends = at + timedelta(minutes=600)
                following = quotes[k + 1][1] if k + 1 < len(quotes) else until
                if ends < following:
                    out.append((key, q, None, "unpaid"))
                elif k + 1 < len(quotes):
                    out.append((key, q, None, "replaced"))
    return sorted(out, key=repr)


def test_each_payment_has_one_reason(spark, tmp_path):
    r = random.Random(8)
    events = [(r.randint(1, 4), START + timedelta(minutes=r.randint(0, 9000)), i, r.choice(["quote", "payment", "payment"]), float(r.randint(1, 4)), r.choice([None, "a", "b", "c", "d", "e"])) for i in range(300)]
    schema = "key long, ts timestamp, id long, kind string, amount double, txid string"
    frame = spark.createDataFrame(events, schema)
    newest = max(e[1] for e in events)
    as_of = ordered.watermark(frame, lambda t: t - F.expr("INTERVAL 2 DAYS"))
    got = lambda rows: sorted(((x.key, x.quote_id, x.payment_id, x.reason) for x in rows.collect()), key=repr)
    want = slow_settled(events, newest - timedelta(days=2))
    assert {w[3] for w in want} == {"paid", "unknown", "used", "expired", "underpaid", "reused", "unpaid", "replaced"}
    assert got(ordered.walked_batch(frame, ordered.Payments, as_of)) == want
    # the newest event comes in the last file, so none is late; the others come in any order
    own = ordered.stateful_session(spark)
    parts = [9 if e[1] == newest else r.randint(0, 3) for e in events]
    stream = ordered.walked_stream(replay(own, events, schema, parts, tmp_path), ordered.Payments, "2 days")
    kept = [e for e, p in zip(events, parts)]
    late_by = max((max((x[1] for x, q in zip(events, parts) if q < p), default=START) - e[1] for e, p in zip(events, parts)), default=timedelta())
    if late_by <= timedelta(days=2):
        assert got(live.drained(stream, "append", ["key", "quote_id", "payment_id"], str(tmp_path))) == want
    stream = ordered.walked_stream(replay(own, kept, schema, [0] * len(kept), tmp_path), ordered.Payments, "2 days")
    assert got(live.drained(stream, "append", ["key", "quote_id", "payment_id"], str(tmp_path))) == want


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, START + timedelta(hours=r.randint(0, 400)) if i % 50 else None) for i in range(500)]
    parts = [r.randint(0, 5) for _ in rows]
    split = late.split_late(replay(spark, rows, "id long, ts timestamp", parts, tmp_path).drop("part"), 3_600_000 * 24, str(tmp_path))
    want, newest = {}, None
    for p in sorted(set(parts)):
        own = [(i, ts) for (i, ts), q in zip(rows, parts) if q == p]
        want |= {i: bool(newest and ts and ts < newest - timedelta(days=1)) for i, ts in own}
        newest = max([t for _, t in own if t] + [newest] * bool(newest))
    assert {x.id: x.late for x in split.collect()} == want and any(want.values()) and split.count() == len(rows)
    counts = late.late_counts(split).collect()
    assert sum(c.kept for c in counts) == sum(not x for x in want.values()) and sum(c.late for c in counts) == sum(want.values())


def test_a_batch_done_again_doubles_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "up", START), (2, "down", START)], "id long, rating string, ts timestamp").write.parquet(f"{tmp_path}/r.parquet")
    stream = spark.readStream.schema("id long, rating string, ts timestamp").parquet(f"{tmp_path}/r.parquet*")
    first = live.drained(stream, "append", ["id"], f"{tmp_path}/x")
    assert first.count() == 2
    import glob

    assert [p.rpartition("/")[2] for p in glob.glob(f"{tmp_path}/x/stream-*/out/*") if "__batch" in p] == ["__batch=0"]
