"""Names and implicit marks of resources: as-of joins over three key spaces, name to correlation to driver id to resource, in event-time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import trace
from . import intervals, replay

BUFFER, HEAP, NAMED = 1, 11, (0, 1, 11)  # fixed values: only images, buffers and heaps have names


def _life(tokens: DataFrame) -> DataFrame:
    made = tokens.where((F.col("kind") == trace.CREATE) & F.col("resource_type").isin(*NAMED))
    return made.select("trace_id", "driver_id", F.col("ts").alias("t"), "seq", F.struct(F.col("seq").alias("create_seq"), F.col("ts").alias("create_ts"), "driver_id", "resource_type").alias("made"))


def resolved(tokens: DataFrame) -> DataFrame:
    """Name and mark tokens with event_time (their time less their delay; before the trace: dropped) and the resource that their id means then: made (create_seq, create_ts, driver_id, resource_type; null: none) and direct.

    An id is a driver id or a correlation id. In a trace without correlations it is the driver id
    of the resource created last. In others it is that only for a buffer that no correlation
    has renamed since; else the last correlation of that id tells the driver id, and means
    the resource that this had at the correlation. Events of one time go by their number.
    """
    life = _life(tokens)
    user = tokens.where(F.col("kind") == trace.USERDATA)
    links = user.where(F.col("user_kind") == trace.CORRELATION).select("trace_id", "driver_id", F.col("ts").alias("t"), "seq", "correlation_id")
    linked = intervals.asof_last(life.unionByName(links, allowMissingColumns=True), F.col("made"), ["trace_id", "driver_id"], ["t", "seq"], "_made").where("correlation_id IS NOT NULL")
    asked = user.where(F.col("user_kind").isin(trace.NAME, trace.NAME_2) & F.col("name").isNotNull() | F.col("user_kind").isin(trace.MARK, trace.MARK_2))
    asked = asked.withColumn("t", F.expr("ts - coalesce(delay, 0)")).where("t >= 0").select("trace_id", F.col("driver_id").alias("id"), "t", "seq", "user_kind", "name", "implicit")
    empty = F.lit(None).cast(life.schema["made"].dataType)
    events = life.select("trace_id", F.col("driver_id").alias("id"), "t", "seq", F.struct("made").alias("_direct"))
    events = events.unionByName(links.select("trace_id", F.col("driver_id").alias("id"), "t", "seq", F.struct(empty.alias("made")).alias("_direct")))
    events = events.unionByName(linked.select("trace_id", F.col("correlation_id").alias("id"), "t", "seq", F.struct(F.col("_made").alias("made")).alias("_via")), allowMissingColumns=True)
    order = Window.partitionBy("trace_id", "id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.unionByName(asked, allowMissingColumns=True).withColumns({c: F.last(c, True).over(order)["made"] for c in ("_direct", "_via")}).where("user_kind IS NOT NULL")
    correlated = links.select("trace_id").distinct().withColumn("_any", F.lit(True))
    seen = seen.join(correlated, "trace_id", "left").withColumn("direct", F.coalesce(F.col("_direct.resource_type") == BUFFER, F.lit(False)) & F.col("_any").isNotNull())
    made = F.when(F.col("direct") | F.col("_any").isNull(), F.col("_direct")).otherwise(F.col("_via"))
    return seen.select("trace_id", "id", "seq", F.col("t").alias("event_time"), "user_kind", "name", "implicit", made.alias("made"), "direct")


def names(tokens: DataFrame) -> DataFrame:
    """(trace_id, driver_id, create_seq, create_ts, event_time, name): names of resources, one for each time.

    A name whose id means no resource yet belongs to the one that the id's next name finds, if
    that exists by then (direct matches take no earlier ones along). Of two names of one time the first counts.
    """
    found = resolved(tokens).where("name IS NOT NULL")
    later = Window.partitionBy("trace_id", "id").orderBy(F.col("event_time").desc(), F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    following = F.last(F.when(~F.col("direct"), F.col("made")), True).over(later)
    owned = found.withColumn("made", F.coalesce("made", following)).where("made.create_ts <= event_time")
    one = owned.groupBy("trace_id", "made", "event_time").agg(F.min_by("name", "seq").alias("name"))
    return one.select("trace_id", F.col("made.driver_id").alias("driver_id"), F.col("made.create_seq").alias("create_seq"), F.col("made.create_ts").alias("create_ts"), "event_time", "name")


def names_at(named: DataFrame, t: Column) -> DataFrame:
    """(trace_id, driver_id, create_seq, name) at time t: the latest name up to t, else the first later one."""
    upto = F.when(F.col("event_time") <= t, F.col("event_time"))
    return named.groupBy("trace_id", "driver_id", "create_seq").agg(F.coalesce(F.max_by("name", upto), F.min_by("name", "event_time")).alias("name"))


def pairs(tokens: DataFrame, state: DataFrame) -> DataFrame:
    """(trace_id, alloc_seq, heap, paired): the first heap and the first image or buffer bound at the base of each allocation; both are (driver_id, create_seq). state: replay.swept of the same tokens."""
    found = state.where(F.col("kind") == trace.BIND).select("trace_id", "seq", "base", "alloc_seq")
    binds = replay.lives(tokens).where((F.col("kind") == trace.BIND) & F.col("created_type").isin(*NAMED)).select("trace_id", "seq", "va", "created_type", F.struct("driver_id", "create_seq").alias("who"))
    at_base = binds.join(found, ["trace_id", "seq"]).where("va = base")
    first = lambda cond: F.min_by(F.when(cond, F.col("who")), F.when(cond, F.col("seq")))
    both = at_base.groupBy("trace_id", "alloc_seq").agg(first(F.col("created_type") == HEAP).alias("heap"), first(F.col("created_type") != HEAP).alias("paired"))
    return both.where("heap IS NOT NULL AND paired IS NOT NULL")


def implicit(tokens: DataFrame, state: DataFrame) -> DataFrame:
    """(trace_id, driver_id, create_seq, kind): resources that are marked as implicit, and heaps that are so by a mark of their paired resource (kind heap).

    A resource and its heap are never both implicit: the heap's mark takes the resource's away, whichever comes first.
    """
    marks = resolved(tokens).where(F.col("user_kind").isin(trace.MARK, trace.MARK_2) & F.col("made").isNotNull())
    marked = marks.select("trace_id", F.struct(F.col("made.driver_id").alias("driver_id"), F.col("made.create_seq").alias("create_seq")).alias("who"), (F.coalesce("implicit", F.lit(0)) == trace.IMPLICIT_HEAP).alias("of_heap"))
    paired = pairs(tokens, state).select("trace_id", F.col("paired").alias("who"), "heap").distinct()
    heaps = marked.where("of_heap").join(paired, ["trace_id", "who"]).select("trace_id", F.col("heap").alias("who")).distinct()
    own = marked.where("NOT of_heap").select("trace_id", "who").distinct()
    held = heaps.unionByName(own).distinct().select("trace_id", F.col("who").alias("heap"))
    kept = own.join(paired.join(held, ["trace_id", "heap"], "left_semi"), ["trace_id", "who"], "left_anti").join(heaps, ["trace_id", "who"], "left_anti")
    both = heaps.withColumn("kind", F.lit("heap")).unionByName(kept.withColumn("kind", F.lit("resource")))
    return both.select("trace_id", "who.driver_id", "who.create_seq", "kind")


def visible(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of resources (trace_id, driver_id, create_seq) without the implicit ones."""
    return rows.join(marked.select("trace_id", "driver_id", "create_seq"), ["trace_id", "driver_id", "create_seq"], "left_anti")
