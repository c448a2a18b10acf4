"""Residency and CPU maps of allocations, as a batch and as a stream: last operations, whether it ever was so, and counts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import trace

KEYS = ("trace_id", "alloc_seq")
STATE = "adds long, removes long, maps long, resident boolean, mapped boolean, was_resident boolean, was_evicted boolean, was_mapped boolean, last_residency long, last_map long, last_unmap long"


def touches(tokens: DataFrame, state: DataFrame) -> DataFrame:
    """(trace_id, alloc_seq, seq, ts, what): references (add, remove) and CPU maps (map, unmap) of the allocations that live at their address then. state: replay.swept of the same tokens."""
    found = state.where(F.col("kind").isin(trace.REFERENCE, trace.CPU_MAP)).select("trace_id", "seq", "alloc_seq")
    what = F.when(F.col("kind") == trace.REFERENCE, F.when(F.col("op") == 0, "add").otherwise("remove")).otherwise(F.when(F.col("unmap"), "unmap").otherwise("map"))
    return tokens.where(F.col("kind").isin(trace.REFERENCE, trace.CPU_MAP)).select("trace_id", "seq", "ts", what.alias("what")).join(found, ["trace_id", "seq"])


def residency(touched: DataFrame) -> DataFrame:
    """One row for each touched allocation: adds and removes, maps (less unmaps), whether it is and ever was resident and mapped, and last times."""
    is_ = lambda *w: F.col("what").isin(*w)
    last = lambda *w: F.max_by("what", F.when(is_(*w), F.col("seq")))
    return touched.groupBy(*KEYS).agg(
        F.count_if(is_("add")).alias("adds"), F.count_if(is_("remove")).alias("removes"), (F.count_if(is_("map")) - F.count_if(is_("unmap"))).alias("maps"),
        F.coalesce(last("add", "remove") == "add", F.lit(False)).alias("resident"), F.coalesce(last("map", "unmap") == "map", F.lit(False)).alias("mapped"),
        F.bool_or(is_("add")).alias("was_resident"), F.bool_or(is_("remove")).alias("was_evicted"), F.bool_or(is_("map")).alias("was_mapped"),
        F.max(F.when(is_("add", "remove"), F.col("ts"))).alias("last_residency"), F.max(F.when(is_("map"), F.col("ts"))).alias("last_map"), F.max(F.when(is_("unmap"), F.col("ts"))).alias("last_unmap"),
    )


def residency_stream(touched: DataFrame) -> DataFrame:
    """The same as a stateful stream keyed by allocation: each micro-batch gives the new state of the allocations that it touches.

    seq must be a number. Counts add up and what happened last goes by seq, so tokens may come in any order; the last row
    of an allocation is that of the batch form over the same tokens. State is a row of numbers for each allocation.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.split()[0] for c in STATE.split(", ")]
    kept = "adds long, removes long, maps long, unmaps long, residency_seq long, resident boolean, map_seq long, mapped boolean, last_residency long, last_map long, last_unmap long"

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        adds, removes, maps, unmaps, residency_seq, resident, map_seq, mapped, last_residency, last_map, last_unmap = state.get if state.exists else (0, 0, 0, 0, -1, False, -1, False, None, None, None)
        latest = lambda old, new: new if old is None else max(old, new)
        for pdf in frames:
            for seq, ts, what in zip(pdf["seq"].tolist(), pdf["ts"].tolist(), pdf["what"].tolist(), strict=True):
                if what in ("add", "remove"):
                    adds, removes, last_residency = adds + (what == "add"), removes + (what == "remove"), latest(last_residency, ts)
                    if seq > residency_seq:
                        residency_seq, resident = seq, what == "add"
                else:
                    maps, unmaps = maps + (what == "map"), unmaps + (what == "unmap")
                    last_map, last_unmap = (latest(last_map, ts), last_unmap) if what == "map" else (last_map, latest(last_unmap, ts))
                    if seq > map_seq:
                        map_seq, mapped = seq, what == "map"
        state.update((adds, removes, maps, unmaps, residency_seq, resident, map_seq, mapped, last_residency, last_map, last_unmap))
        row = (*key, adds, removes, maps - unmaps, resident, mapped, adds > 0, removes > 0, maps > 0, last_residency, last_map, last_unmap, max(residency_seq, map_seq))
        out = pd.DataFrame([row], columns=[*KEYS, *names, "seq"])
        yield out.astype({c: "Int64" for c in ("last_residency", "last_map", "last_unmap")})

    trace_type = touched.schema["trace_id"].dataType.simpleString()
    return touched.select(*KEYS, "seq", "ts", "what").groupBy(*KEYS).applyInPandasWithState(advance, f"trace_id {trace_type}, alloc_seq long, {STATE}, seq long", kept, "update", GroupStateTimeout.NoTimeout)
