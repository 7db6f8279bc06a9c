"""Per-user gap between orders across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLOTS = 1024  # of users; part of the state's key, so a checkpoint keeps the number it began with
NULL_SLOT = -1
OUTPUT = "us long, payload string, time_diff double"
STATE = "users array<long>, last_us array<long>"


def _gaps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State is the latest order time of each user of a slot; an older order gets no gap and leaves it unchanged.

    So does an order without a time.
    """
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    timed = rows["us"].notna().to_numpy()
    us, users = rows["us"].fillna(0).to_numpy(np.int64), rows["user"].to_numpy(np.int64)
    known, last = (np.array(held, np.int64) for held in (state.get if state.exists else ((), ())))
    order = np.lexsort((rows["event"].to_numpy(np.int64), us, users))
    order = order[timed[order]]
    at = np.searchsorted(known, users[order])
    seen = at < len(known)
    seen[seen] = known[at[seen]] == users[order[seen]]
    before = np.full(len(order), np.nan)
    before[seen] = last[at[seen]]
    timely = ~(us[order] < before)
    order, before = order[timely], before[timely]
    gap = np.full(len(rows), np.nan)
    if len(order):
        same = users[order[1:]] == users[order[:-1]]
        before[1:][same] = us[order[:-1]][same]
        gap[order] = (us[order] - before) / 1e6
        ends = order[np.append(~same, True)]
        kept = ~np.isin(known, users[ends])
        merged, times = np.append(known[kept], users[ends]), np.append(last[kept], us[ends])
        sort = np.argsort(merged)
        state.update((merged[sort].tolist(), times[sort].tolist()))
    yield pd.DataFrame({"us": pd.Series(us, rows.index).astype("Int64").where(timed), "payload": rows["payload"], "time_diff": gap})


def stream_gap_state(orders: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Add ``time_diff`` to a stream of orders; the state kept per user is an id and one timestamp.

    Users share ``slots`` by the hash of their id, so a batch costs one Python call per slot, however many users it has.
    One slot's rows of one micro-batch are sorted in one task, so the source limit
    (``max_files`` or ``max_bytes``) is what bounds that task.
    """
    carried = [f for f in orders.schema if f.name not in ("user_id", "event_id", "ts")]
    ids = [F.col(c).cast("long").alias(c) for c in ("user_id", "event_id")]
    slot = F.when(ids[0].isNull(), NULL_SLOT).otherwise(F.pmod(F.xxhash64(ids[0]), F.lit(slots)).cast("int"))
    # each column costs a conversion per slot and batch, so those the gap does not need travel as one
    packed = orders.select(
        slot.alias("slot"),
        F.coalesce(ids[0], F.lit(0)).alias("user"),
        F.coalesce(ids[1], F.lit(2**63 - 1)).alias("event"),
        F.unix_micros("ts").alias("us"),
        F.to_json(F.struct(*ids, *[f.name for f in carried])).alias("payload"),
    )
    gapped = packed.groupBy("slot").applyInPandasWithState(_gaps, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    layout = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), *carried])
    unpacked = F.from_json("payload", layout).alias("p")
    return gapped.select("us", "time_diff", unpacked).select(
        "p.user_id", "p.event_id", F.timestamp_micros("us").alias("ts"), "time_diff", *[f"p.`{f.name}`" for f in carried]
    )
