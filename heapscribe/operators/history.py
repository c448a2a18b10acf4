"""Histories: every event that touches an address, or a resource, from tokens and the replay of their allocations.

`state` is replay.swept of the same tokens. Intervals meet points and each other by binned
joins, so an address list of any length is one query; no allocation's events are multiplied by its resources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..sources import trace
from . import intervals, replay

BIN = 1 << 24  # bytes of address space to a bin of the joins
_LABELS = {trace.CREATE: "create", trace.BIND: "bind", trace.DESTROY: "destroy", trace.ALLOCATE: "allocate", trace.FREE: "free"}


def event_name() -> Column:
    """What a token is called in a history."""
    kind, out = F.col("kind"), None
    for k, name in _LABELS.items():
        out = F.when(kind == k, name) if out is None else out.when(kind == k, name)
    out = out.when(kind == trace.REFERENCE, F.when(F.col("op") == 0, "make resident").otherwise("evict"))
    out = out.when(kind == trace.CPU_MAP, F.when(F.col("unmap"), "cpu unmap").otherwise("cpu map"))
    return out.when(kind == trace.TABLE_UPDATE, F.when(F.col("unmap"), "unmap").when(F.col("pa") == 0, "map to host").otherwise("map to local"))


def _made(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("kind") == trace.ALLOCATE).select("trace_id", F.col("seq").alias("alloc_seq"), F.col("va").alias("base"), F.expr("va + size").alias("end"))


def blocks(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """(trace_id, address, base, end): every allocation that was ever made over each address of asked (trace_id, address), taken or not."""
    made = _made(tokens).select("trace_id", "base", "end").distinct()
    return intervals.range_join(asked, made, "address", "base", "end", BIN, ("trace_id",)).select("trace_id", "address", "base", "end").distinct()


def basic(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """(trace_id, address, seq, ts, event, va): allocations that hold an address, and frees at their bases."""
    over = blocks(tokens, asked)
    made = tokens.where(F.col("kind") == trace.ALLOCATE).select("trace_id", "seq", "ts", F.col("va").alias("base"), F.expr("va + size").alias("end"))
    made = made.join(over, ["trace_id", "base", "end"]).select("trace_id", "address", "seq", "ts", F.lit("allocate").alias("event"), F.col("base").alias("va"))
    bases = over.select("trace_id", "address", F.col("base").alias("va")).distinct()
    freed = tokens.where(F.col("kind") == trace.FREE).join(bases, ["trace_id", "va"]).select("trace_id", "address", "seq", "ts", F.lit("free").alias("event"), "va")
    return made.unionByName(freed)


def touching(tokens: DataFrame, asked: DataFrame, everything: bool = False) -> DataFrame:
    """(trace_id, address, driver_id, create_seq): resources that a bind puts over each address; everything: anywhere in an allocation that was ever made over it."""
    binds = replay.lives(tokens).where(F.col("kind") == trace.BIND)
    if everything:
        at = binds.select("trace_id", "driver_id", "create_seq", "va")
        found = intervals.range_join(at, blocks(tokens, asked), "va", "base", "end", BIN, ("trace_id",))
    else:
        at = binds.select("trace_id", "driver_id", "create_seq", "va", F.expr("va + size").alias("end"))
        found = intervals.range_join(asked, at, "address", "va", "end", BIN, ("trace_id",))
    return found.select("trace_id", "address", "driver_id", "create_seq").distinct()


def full(tokens: DataFrame, state: DataFrame, asked: DataFrame, everything: bool = False, hidden: DataFrame | None = None) -> DataFrame:
    """(trace_id, address, seq, ts, event, driver_id, va, base, bound): the whole history of each address.

    Creates, binds and destroys of the resources of `touching`; allocations and frees at the
    bases of allocations over the address, reuse of the base by others included; references, CPU maps and
    page-table updates anywhere in these. A bind counts if its allocation is one of these, or
    if a heap is bound. References list the driver ids of the resources that binds of this history have put in their
    allocation so far. hidden: implicit resources (trace_id, driver_id, create_seq) to leave out.
    """
    over = blocks(tokens, asked)
    bases = over.select("trace_id", "address", "base").distinct()
    found = state.where(F.col("base").isNotNull()).select("trace_id", "seq", "base", "alloc_seq")
    own = touching(tokens, asked, everything)
    if hidden is not None:
        own = own.join(hidden.select("trace_id", "driver_id", "create_seq"), ["trace_id", "driver_id", "create_seq"], "left_anti")
    of_resources = replay.lives(tokens).where(F.col("kind").isin(trace.CREATE, trace.BIND, trace.DESTROY)).join(own, ["trace_id", "driver_id", "create_seq"])
    of_resources = of_resources.join(found, ["trace_id", "seq"], "left").join(bases.withColumn("_own", F.lit(True)), ["trace_id", "address", "base"], "left")
    counts = (F.col("kind") != trace.BIND) | F.col("base").isNotNull() & ((F.col("created_type") == 11) | F.col("_own"))
    named = ["trace_id", "address", "seq", "ts", event_name().alias("event")]
    none = [F.lit(None).cast("long").alias("driver_id")]
    parts = of_resources.where(counts).select(*named, "driver_id", "va", "base", "alloc_seq")
    on_base = tokens.where(F.col("kind").isin(trace.ALLOCATE, trace.FREE)).join(bases.withColumnRenamed("base", "va"), ["trace_id", "va"])
    parts = parts.unionByName(on_base.select(*named, *none, "va"), allowMissingColumns=True)
    places = tokens.where(F.col("kind").isin(trace.REFERENCE, trace.CPU_MAP, trace.TABLE_UPDATE))
    inside = intervals.range_join(places, over.withColumnRenamed("base", "_base"), "va", "_base", "end", BIN, ("trace_id",)).select(*named, "va").distinct()
    inside = inside.join(found, ["trace_id", "seq"], "left").join(bases.withColumn("_own", F.lit(True)), ["trace_id", "address", "base"], "left")
    inside = inside.select("trace_id", "address", "seq", "ts", "event", *none, "va", F.when(F.col("_own"), F.col("base")).alias("base"), F.when(F.col("_own"), F.col("alloc_seq")).alias("alloc_seq"))
    parts = parts.unionByName(inside)
    before = Window.partitionBy("trace_id", "address", "alloc_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    listed = F.collect_list(F.when((F.col("event") == "bind") & F.col("alloc_seq").isNotNull(), F.col("driver_id"))).over(before)
    swap = F.col("event").isin("make resident", "evict") & F.col("alloc_seq").isNotNull()
    with_lists = parts.where("alloc_seq IS NOT NULL").withColumn("bound", listed).withColumn("bound", F.when(swap, F.col("bound")))
    rest = parts.where("alloc_seq IS NULL").withColumn("bound", F.lit(None).cast("array<bigint>"))
    return with_lists.unionByName(rest).drop("alloc_seq")


def every(tokens: DataFrame, state: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(trace_id, seq, ts, event, driver_id, create_seq, va, bound): creates, binds and destroys of all resources, and the residency changes of allocations with the driver ids of the resources that are bound in them then, in order.

    A destroy takes out its own resource only. hidden: implicit resources (trace_id, driver_id, create_seq) to leave out.
    """
    own = replay.lives(tokens).where(F.col("kind").isin(trace.CREATE, trace.BIND, trace.DESTROY))
    if hidden is not None:
        own = own.join(hidden.select("trace_id", "driver_id", "create_seq"), ["trace_id", "driver_id", "create_seq"], "left_anti")
    found = state.where(F.col("base").isNotNull()).select("trace_id", "seq", "alloc_seq")
    out = own.select("trace_id", "seq", "ts", event_name().alias("event"), "driver_id", "create_seq", "va", F.lit(None).cast("array<bigint>").alias("bound"))
    gone = own.where(F.col("kind") == trace.DESTROY).select("trace_id", "driver_id", "create_seq", F.col("seq").alias("_gone"))
    bound = own.where(F.col("kind") == trace.BIND).join(found, ["trace_id", "seq"]).select("trace_id", "alloc_seq", "driver_id", "create_seq", F.col("seq").alias("_bound")).join(gone, ["trace_id", "driver_id", "create_seq"], "left")
    swaps = tokens.where(F.col("kind") == trace.REFERENCE).select("trace_id", "seq", "ts", event_name().alias("event"), "va").join(found, ["trace_id", "seq"])
    lists = swaps.select("trace_id", "seq", "alloc_seq").join(bound, ["trace_id", "alloc_seq"]).where((F.col("_bound") < F.col("seq")) & (F.col("_gone").isNull() | (F.col("_gone") > F.col("seq"))))
    lists = lists.groupBy("trace_id", "seq").agg(F.sort_array(F.collect_set("driver_id")).alias("bound"))
    return out.unionByName(swaps.drop("alloc_seq").join(lists, ["trace_id", "seq"], "left").withColumn("bound", F.coalesce("bound", F.array().cast("array<bigint>"))), allowMissingColumns=True)


def enriched_binds(tokens: DataFrame, state: DataFrame) -> DataFrame:
    """(trace_id, seq, driver_id, va, base, pref): binds with the base and the preferences of the allocation that they find."""
    found = state.where((F.col("kind") == trace.BIND) & F.col("base").isNotNull()).select("trace_id", "seq", "base", "alloc_seq")
    made = state.where((F.col("kind") == trace.ALLOCATE) & F.col("taken")).select("trace_id", F.col("seq").alias("alloc_seq"), "pref")
    return tokens.where(F.col("kind") == trace.BIND).select("trace_id", "seq", "driver_id", "va").join(found, ["trace_id", "seq"]).join(made, ["trace_id", "alloc_seq"]).drop("alloc_seq")


def _update_end(tokens: DataFrame) -> Column:
    """Where a page-table update ends: by its pages, or by `size` where tokens have no such column."""
    if "pages" not in tokens.columns:
        return F.col("va") + F.col("size")
    return F.col("va") + F.col("pages") * scalars.page_bytes(F.col("page_size"))


def of_resources(tokens: DataFrame, state: DataFrame, asked: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(trace_id, driver_id, create_seq, seq, ts, event, va): histories of the resources of asked (trace_id, driver_id, create_seq).

    Their creates, binds and destroys; making, freeing, residency and CPU maps of the allocations that their binds ever found, by
    identity, so that others at the same base don't count; page-table updates that overlap an address range that they were ever
    bound to, those of one kind and time on one address once; and names (of naming.names) in their life.
    """
    key = ["trace_id", "driver_id", "create_seq"]
    own = replay.lives(tokens).where(F.col("kind").isin(trace.CREATE, trace.BIND, trace.DESTROY)).join(asked.select(*key).distinct(), key)
    out = own.select(*key, "seq", "ts", event_name().alias("event"), "va")
    found = state.where(F.col("base").isNotNull()).select("trace_id", "seq", "alloc_seq")
    bound = own.where(F.col("kind") == trace.BIND).join(found, ["trace_id", "seq"])
    held = bound.select(*key, "alloc_seq").distinct()
    made = state.where(F.col("kind") == trace.ALLOCATE)
    ends = made.select("trace_id", F.col("seq").alias("alloc_seq"), F.explode(F.array(F.struct("seq", "ts", F.lit("allocate").alias("event"), "va"), F.struct(F.col("end_seq").alias("seq"), F.col("end_ts").alias("ts"), F.lit("free").alias("event"), "va"))).alias("e")).where("e.seq IS NOT NULL")
    out = out.unionByName(ends.join(held, ["trace_id", "alloc_seq"]).select(*key, "e.seq", "e.ts", "e.event", "e.va"))
    touched = tokens.where(F.col("kind").isin(trace.REFERENCE, trace.CPU_MAP)).select("trace_id", "seq", "ts", event_name().alias("event"), "va").join(found, ["trace_id", "seq"])
    out = out.unionByName(touched.join(held, ["trace_id", "alloc_seq"]).select(*key, "seq", "ts", "event", "va"))
    ranges = bound.select(*key, F.col("va").alias("_lo"), F.expr("va + size").alias("_hi")).distinct()
    updates = tokens.where(F.col("kind") == trace.TABLE_UPDATE).select("trace_id", "seq", "ts", event_name().alias("event"), "va", _update_end(tokens).alias("_end"))
    met = intervals.interval_join(updates, ranges, ("va", "_lo"), ("_end", "_hi"), BIN, ("trace_id",))
    out = out.unionByName(met.groupBy(*key, "ts", "event", "va").agg(F.min("seq").alias("seq")))
    if named is not None:
        destroyed = own.where(F.col("kind") == trace.DESTROY).select(*key, F.col("ts").alias("_gone"))
        following = replay.lives(tokens).where(F.col("kind") == trace.CREATE).select("trace_id", "driver_id", "create_seq", F.lead("ts").over(Window.partitionBy("trace_id", "driver_id").orderBy("seq")).alias("_next"))
        life = asked.select(*key).distinct().join(destroyed, key, "left").join(following, key, "left")
        within = named.join(life, key).where("event_time >= create_ts AND (_gone IS NULL AND _next IS NULL OR event_time < coalesce(_gone, _next))")
        out = out.unionByName(within.select(*key, F.lit(None).cast(tokens.schema["seq"].dataType).alias("seq"), F.col("event_time").alias("ts"), F.lit("name").alias("event"), F.lit(None).cast("long").alias("va")))
    return out
