"""Registered queries over the driver's tables, with SQL for each that SQL can express.

A query is either one text that Spark and an ANSI engine both read (filters, joins,
aggregates, windows) or a DataFrame operator of this library with an independent SQL
text for the check. Keys begin with the numbers of the inventory rows that they cover.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import enums, scalars
from .operators import aliasing, intervals, layout, replay
from .plans import proxies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW, BEFORE, AFTER = 1_000_000, 800_000, 1_600_000


def at(t: int, table: str = "allocs") -> str:
    """State at t: the rows whose validity interval holds it."""
    start = "alloc_ts" if table == "allocs" else "bind_ts"
    return f"(SELECT * FROM {{{table}}} WHERE {start} <= {t} AND (free_ts IS NULL OR free_ts > {t}))"


def sql(name: str, text: str, other: str | None = None) -> None:
    """Registers a text that both engines read; `other` is one for the check that says the same in another way."""
    QUERIES[name] = lambda spark, sf_dir: proxies.query(spark, sf_dir, text)
    ORACLE_SQL[name] = proxies.oracle(other or text)


def frame(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of (view, spark), where view(name) gives a proxy and view(text) runs one."""

    def wrap(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda v: proxies.query(spark, sf_dir, v) if " " in v else proxies.view(spark, sf_dir, v))

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = proxies.oracle(oracle)
        return f

    return wrap


# --- timelines -----------------------------------------------------------------------------


def deltas(rows: DataFrame, series: str, value, start: str = "alloc_ts", end: str = "free_ts") -> DataFrame:
    """Signed changes at both ends of validity intervals; ends after the last start lie outside the trace."""
    opened = rows.select(F.col(start).alias("ts"), series, value.alias("delta"))
    last = F.broadcast(rows.agg(F.max(start).alias("_max")))
    closed = rows.where(F.col(end).isNotNull()).join(last, F.col(end) <= F.col("_max")).select(F.col(end).alias("ts"), series, (-value).alias("delta"))
    return opened.unionAll(closed)


def _timeline_sql(rows: str, series: str, value: str, start: str) -> str:
    return f"""
WITH src AS (SELECT * FROM {rows} x), top AS (SELECT max({start}) AS m FROM src),
d AS (SELECT {start} // {scalars.BUCKET} AS bucket, {series} AS s, {value} AS delta FROM src
      UNION ALL SELECT free_ts // {scalars.BUCKET}, {series}, -({value}) FROM src, top WHERE free_ts <= m),
b AS (SELECT bucket, s, sum(delta) AS delta FROM d GROUP BY bucket, s),
g AS (SELECT r.range AS bucket, k.s FROM range(0, (SELECT max(bucket) + 1 FROM d)) r CROSS JOIN (SELECT DISTINCT s FROM d) k)
SELECT CAST(g.bucket AS BIGINT) AS bucket, g.s AS {series}, CAST(sum(coalesce(b.delta, 0)) OVER (PARTITION BY g.s ORDER BY g.bucket) AS BIGINT) AS value
FROM g LEFT JOIN b ON b.bucket = g.bucket AND b.s = g.s"""


@frame("w01_w05_w06_live_bytes", _timeline_sql("{allocs}", "heap", "size", "alloc_ts"))
def live_bytes(view):
    return intervals.step_timeline(deltas(view("allocs"), "heap", F.col("size")), "heap", scalars.BUCKET)


@frame("w02_resource_counts", _timeline_sql("(SELECT * FROM {res} WHERE usage <> 2)", "usage", "CAST(1 AS BIGINT)", "bind_ts"))
def resource_counts(view):
    return intervals.step_timeline(deltas(view("res").where("usage <> 2"), "usage", F.lit(1).cast("long"), "bind_ts"), "usage", scalars.BUCKET)


_ALIASED = """(SELECT g.alloc_id, g.s, g.e - g.s AS width, r.res_id, r.usage, r.bind_ts, r.free_ts
  FROM (SELECT alloc_id, p AS s, lead(p) OVER (PARTITION BY alloc_id ORDER BY p) AS e
        FROM (SELECT alloc_id, off AS p FROM {res} WHERE usage <> 2 UNION SELECT alloc_id, off + rsize FROM {res} WHERE usage <> 2) q) g
  JOIN {res} r ON r.alloc_id = g.alloc_id AND r.off <= g.s AND r.off + r.rsize >= g.e WHERE g.e IS NOT NULL AND r.usage <> 2)"""


#: Aliased bytes told segment by segment: at each time at which something begins or ends over one, the highest usage that lives there.
_TOPS = f"""t AS (SELECT DISTINCT alloc_id, s, ts FROM (SELECT alloc_id, s, a AS ts FROM c UNION ALL SELECT alloc_id, s, b FROM c WHERE b IS NOT NULL) u),
p AS (SELECT t.alloc_id, t.s, t.ts, max(c.usage) AS top FROM t LEFT JOIN c ON c.alloc_id = t.alloc_id AND c.s = t.s AND c.a <= t.ts AND (c.b IS NULL OR t.ts < c.b) GROUP BY ALL),
w AS (SELECT DISTINCT alloc_id, s, width FROM c),
n AS (SELECT p.ts, p.top, lag(p.top) OVER (PARTITION BY p.alloc_id, p.s ORDER BY p.ts) AS former, w.width FROM p JOIN w ON w.alloc_id = p.alloc_id AND w.s = p.s),
d AS (SELECT ts // {scalars.BUCKET} AS bucket, top AS usage, width AS delta FROM n WHERE top IS NOT NULL AND (former IS NULL OR top <> former) UNION ALL SELECT ts // {scalars.BUCKET}, former, -width FROM n WHERE former IS NOT NULL AND (top IS NULL OR top <> former)),
g AS (SELECT r.range AS bucket, k.usage FROM range(0, (SELECT max(bucket) + 1 FROM d)) r CROSS JOIN (SELECT DISTINCT usage FROM d) k)
SELECT CAST(g.bucket AS BIGINT) AS bucket, g.usage, CAST(sum(coalesce(b.delta, 0)) OVER (PARTITION BY g.usage ORDER BY g.bucket) AS BIGINT) AS value
FROM g LEFT JOIN (SELECT bucket, usage, sum(delta) AS delta FROM d GROUP BY bucket, usage) b ON b.bucket = g.bucket AND b.usage = g.usage"""


@frame(
    "w03_aliased_bytes_timeline",
    f"WITH c AS (SELECT alloc_id, s, width, usage, bind_ts AS a, CASE WHEN free_ts <= (SELECT max(bind_ts) FROM {{res}} WHERE usage <> 2) THEN free_ts END AS b FROM {_ALIASED} x WHERE free_ts IS NULL OR free_ts > bind_ts), {_TOPS}",
)
def aliased_timeline(view):
    """Aliased bytes in use by usage and bucket; ends after the last bind lie outside the trace."""
    rows = view("SELECT alloc_id, usage, bind_ts, free_ts, off AS lo, off + rsize AS hi FROM {res} WHERE usage <> 2")
    end = F.broadcast(rows.agg(F.max("bind_ts").alias("_max")))  # one row
    ended = rows.crossJoin(end).withColumn("free_ts", F.when(F.col("free_ts") <= F.col("_max"), F.col("free_ts")))
    changes = aliasing.changes(ended, ["alloc_id"], "lo", "hi", "bind_ts", "free_ts", stretch=1 << 18)
    return intervals.step_timeline(changes, "usage", scalars.BUCKET)


sql(
    "w04_a11_a12_committed_bytes",
    """SELECT bind_ts // 3000 AS bucket, heap, CAST(sum(CASE WHEN unmap THEN lo - hi ELSE hi - lo END) AS BIGINT) AS change FROM {maps} WHERE pa <> 0 GROUP BY 1, 2""",
)


@frame(
    "w04_committed_running",
    f"""WITH d AS (SELECT bind_ts // {scalars.BUCKET} AS bucket, heap, CASE WHEN unmap THEN lo - hi ELSE hi - lo END AS delta FROM {{maps}} WHERE pa <> 0), b AS (SELECT bucket, heap, sum(delta) AS delta FROM d GROUP BY bucket, heap),
g AS (SELECT r.range AS bucket, k.heap FROM range(0, (SELECT max(bucket) + 1 FROM d)) r CROSS JOIN (SELECT DISTINCT heap FROM d) k)
SELECT CAST(g.bucket AS BIGINT) AS bucket, g.heap, CAST(sum(coalesce(b.delta, 0)) OVER (PARTITION BY g.heap ORDER BY g.bucket) AS BIGINT) AS value FROM g LEFT JOIN b ON b.bucket = g.bucket AND b.heap = g.heap""",
)
def committed_running(view):
    """Committed bytes of each heap over time: mapped less unmapped."""
    return intervals.step_timeline(view("SELECT bind_ts AS ts, heap, CASE WHEN unmap THEN lo - hi ELSE hi - lo END AS delta FROM {maps} WHERE pa <> 0"), "heap", scalars.BUCKET)


#: Changes by bucket; a running sum is taken within chunks of buckets, whose own sums, a row for each, give the offsets.
_CHANGES = """SELECT bucket, sum(delta) AS delta FROM (SELECT alloc_ts // 3000 AS bucket, size AS delta FROM {allocs}
UNION ALL SELECT free_ts // 3000, -size FROM {allocs} WHERE free_ts <= (SELECT max(alloc_ts) FROM {allocs})) d GROUP BY bucket"""
_BEFORE = "SELECT chunk, coalesce(sum(total) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"
sql(
    "w07_peak_live_bytes",
    f"""WITH changes AS ({_CHANGES}), offsets AS ({_BEFORE} FROM (SELECT bucket // 256 AS chunk, sum(delta) AS total FROM changes GROUP BY 1) c)
SELECT CAST(max(before + run) AS BIGINT) AS peak FROM (SELECT bucket // 256 AS chunk, sum(delta) OVER (PARTITION BY bucket // 256 ORDER BY bucket) AS run FROM changes) r JOIN offsets o ON o.chunk = r.chunk""",
    f"SELECT max(total) AS peak FROM (SELECT CAST(sum(delta) OVER (ORDER BY bucket) AS BIGINT) AS total FROM ({_CHANGES}) b) t",
)


@frame(
    "w08_sampled_histogram",
    _timeline_sql("{allocs}", "heap", "size", "alloc_ts").replace("SELECT CAST(g.bucket", ", line AS (SELECT CAST(g.bucket", 1)
    + """), ends AS (SELECT max(bucket) AS last FROM line)
SELECT CAST(n.range AS INTEGER) AS sample, heap, value FROM range(0, 500) n CROSS JOIN ends JOIN line ON line.bucket = least((n.range * ((last + 1) * 3000 // 500)) // 3000, last)""",
)
def sampled(view):
    line = live_bytes(view)
    last = F.broadcast(line.agg(F.max("bucket").alias("_last")))
    step = F.floor((F.col("_last") + 1) * scalars.BUCKET / 500)
    points = last.select(F.explode(F.sequence(F.lit(0), F.lit(499))).alias("sample"), "_last").withColumn("bucket", F.least(F.floor(F.col("sample") * step / scalars.BUCKET), F.col("_last")))
    return line.join(F.broadcast(points), "bucket").select("sample", "heap", "value")


sql(
    "w09_stacked_share",
    f"""SELECT heap, CAST(sum(bytes) OVER (ORDER BY pos) AS BIGINT) AS stacked, CAST(sum(bytes) OVER () AS BIGINT) AS total FROM (
SELECT heap, sum(size) AS bytes, CASE heap WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS pos FROM {at(NOW)} a GROUP BY heap) s""",
)
sql(
    "w10_w11_duplicate_events",
    """SELECT seq, ts, kind, pid FROM (SELECT *, lag(kind) OVER (PARTITION BY pid ORDER BY seq) AS former, lag(ts) OVER (PARTITION BY pid ORDER BY seq) AS former_ts FROM {toks}) t
WHERE former IS NULL OR former <> kind OR former_ts // 3600 <> ts // 3600""",
)
sql("w14_unique_ids", "SELECT seq, pid * 4294967296 + n - 1 AS unique_id FROM (SELECT seq, pid, row_number() OVER (PARTITION BY pid ORDER BY seq) AS n FROM {toks} WHERE kind = 12) t")
sql(
    "w16_history_marker",  # the marker of time T stands before the first event after T
    """SELECT pid, seq, ts, kind, CAST(row_number() OVER (PARTITION BY pid ORDER BY ts, seq) + CASE WHEN ts > 1000000 THEN 1 ELSE 0 END AS BIGINT) AS place FROM {toks}
UNION ALL SELECT pid, NULL, 1000000, -1, CAST(1 + sum(CASE WHEN ts <= 1000000 THEN 1 ELSE 0 END) AS BIGINT) FROM {toks} GROUP BY pid""",
    """SELECT pid, seq, ts, kind, row_number() OVER (PARTITION BY pid ORDER BY ts, marker, seq) AS place
FROM (SELECT pid, seq, ts, kind, 0 AS marker FROM {toks} UNION ALL SELECT DISTINCT pid, CAST(NULL AS BIGINT), CAST(1000000 AS BIGINT), -1, 1 FROM {toks}) t""",
)
sql(
    "w17_next_event",  # in descending order, so that a frame grows row by row
    "SELECT seq, min(CASE WHEN kind = 11 THEN seq END) OVER (PARTITION BY pid ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS next_free FROM {toks}",
    "SELECT t.seq, (SELECT min(x.seq) FROM {toks} x WHERE x.pid = t.pid AND x.kind = 11 AND x.seq >= t.seq) AS next_free FROM {toks} t",
)

# --- interval kernels ----------------------------------------------------------------------

_RANGES = "SELECT alloc_id, res_id, usage, rsize, off AS lo, off + rsize AS hi FROM {res} WHERE usage <> 2"
_ISLANDS = """WITH o AS (SELECT alloc_id, off AS lo, off + rsize AS hi, max(off + rsize) OVER (PARTITION BY alloc_id ORDER BY off, off + rsize ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {res} WHERE usage <> 2),
n AS (SELECT *, sum(CASE WHEN pe IS NULL OR lo >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY alloc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM o),
i AS (SELECT alloc_id, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY alloc_id, isl)"""


@frame("a03_u05_islands", _ISLANDS + " SELECT alloc_id, lo, hi FROM i")
def islands(view):
    return intervals.islands(view(_RANGES), ["alloc_id"])


@frame(
    "a03_a04_a05_bound_size",
    _ISLANDS + """ SELECT a.alloc_id, a.size, coalesce(b.bound, 0) AS bound, greatest(a.size - coalesce(b.bound, 0), 0) AS unbound, coalesce(b.bound // c.n, 0) AS mean
FROM {allocs} a LEFT JOIN (SELECT alloc_id, CAST(sum(hi - lo) AS BIGINT) AS bound FROM i GROUP BY alloc_id) b ON a.alloc_id = b.alloc_id LEFT JOIN (SELECT alloc_id, count(*) AS n FROM {res} WHERE usage <> 2 GROUP BY alloc_id) c ON a.alloc_id = c.alloc_id""",
)
def bound_size(view):
    ranges = view(_RANGES)
    bound = intervals.islands(ranges, ["alloc_id"]).groupBy("alloc_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("bound"))
    count = ranges.groupBy("alloc_id").agg(F.count("*").alias("n"))
    return view("allocs").join(bound, "alloc_id", "left").join(count, "alloc_id", "left").selectExpr("alloc_id", "size", "coalesce(bound, 0L) AS bound", "greatest(size - coalesce(bound, 0L), 0L) AS unbound", "coalesce(bound div n, 0L) AS mean")


@frame(
    "w12_r23_unbound_gaps",
    _ISLANDS + """, w AS (SELECT alloc_id, lo, hi FROM i UNION ALL SELECT alloc_id, size, size FROM {allocs}),
g AS (SELECT alloc_id, lo AS hi, coalesce(lag(hi) OVER (PARTITION BY alloc_id ORDER BY lo, hi), 0) AS lo FROM w) SELECT alloc_id, lo, hi FROM g WHERE hi > lo""",
)
def unbound_gaps(view):
    return intervals.gaps(intervals.islands(view(_RANGES), ["alloc_id"]), view("allocs"), ["alloc_id"], "size")


@frame(
    "a15_aliased_size_per_usage",
    f"SELECT alloc_id, usage, CAST(sum(width) AS BIGINT) AS bytes FROM (SELECT alloc_id, s, max(usage) AS usage, min(width) AS width FROM {_ALIASED} x GROUP BY alloc_id, s) t GROUP BY alloc_id, usage",
)
def aliased_sizes(view):
    top = intervals.winners(view(_RANGES), ["alloc_id"], [F.col("usage").desc(), F.col("res_id")])
    return top.groupBy("alloc_id", "usage").agg(F.sum("width").alias("bytes"))


@frame(
    "a16_r24_adjusted_size",
    f"""WITH c AS (SELECT x.*, q.rsize FROM {_ALIASED} x JOIN (SELECT res_id AS id, rsize FROM {{res}}) q ON q.id = x.res_id),
w AS (SELECT *, row_number() OVER (PARTITION BY alloc_id, s ORDER BY usage DESC, rsize, res_id DESC) AS k FROM c)
SELECT r.res_id, CASE WHEN r.usage = 2 THEN r.rsize ELSE coalesce(t.bytes, 0) END AS adjusted FROM {{res}} r LEFT JOIN (SELECT res_id, CAST(sum(width) AS BIGINT) AS bytes FROM w WHERE k = 1 GROUP BY res_id) t ON t.res_id = r.res_id""",
)
def adjusted_sizes(view):
    top = intervals.winners(view(_RANGES), ["alloc_id"], [F.col("usage").desc(), F.col("rsize"), F.col("res_id").desc()])
    sizes = top.groupBy("res_id").agg(F.sum("width").alias("bytes"))
    return view("res").join(sizes, "res_id", "left").selectExpr("res_id", "CASE WHEN usage = 2 THEN rsize ELSE coalesce(bytes, 0L) END AS adjusted")


_PAIRS = "FROM {res} a JOIN {res} b ON a.alloc_id = b.alloc_id AND a.res_id <> b.res_id AND a.off < b.off + b.rsize AND b.off < a.off + a.rsize WHERE a.usage <> 2 AND b.usage <> 2"


@frame("j07_a17_alias_count", f"SELECT r.res_id, coalesce(n, 0) AS aliases, coalesce(n, 0) > 0 AS is_aliased FROM {{res}} r LEFT JOIN (SELECT a.res_id AS id, count(*) AS n {_PAIRS} GROUP BY a.res_id) c ON c.id = r.res_id")
def alias_count(view):
    counts = intervals.alias_counts(view(_RANGES), ["alloc_id"], "res_id", chunk=1 << 18).select("res_id", "aliases")
    return view("res").select("res_id").join(counts, "res_id", "left").selectExpr("res_id", "coalesce(aliases, 0L) AS aliases", "coalesce(aliases, 0L) > 0 AS is_aliased")


#: Windows of the address space that a user looks at.
_WINDOWS = "SELECT p_partkey AS win, (p_partkey * 7919 % 15000) * 1048576 + p_size * 4096 AS lo, (p_partkey * 7919 % 15000) * 1048576 + p_size * 4096 + (1 + p_partkey % 5) * 700000 AS hi FROM {part}"
_PLACED = "SELECT res_id, base + off AS lo, base + off + rsize AS hi FROM {res}"


@frame("u06_culled_overlap", f"SELECT w.win, r.res_id, greatest(w.lo, r.lo) AS lo, least(w.hi, r.hi) AS hi FROM ({_WINDOWS}) w JOIN ({_PLACED}) r ON r.lo < w.hi AND w.lo < r.hi")
def culled(view):
    """What of each resource lies in each window, clipped to it."""
    windows = view(_WINDOWS).withColumnsRenamed({"lo": "w_lo", "hi": "w_hi"})
    met = intervals.interval_join(windows, view(_PLACED), ("w_lo", "lo"), ("w_hi", "hi"), 1 << 20)
    return met.select("win", "res_id", F.greatest("w_lo", "lo").alias("lo"), F.least("w_hi", "hi").alias("hi"))


sql(
    "a07_fragmentation",
    """SELECT alloc_id, CAST(sum(CASE WHEN off <> pe THEN 1 ELSE 0 END) AS BIGINT) AS fragments FROM (
SELECT alloc_id, off, lag(off + rsize, 1, 0) OVER (PARTITION BY alloc_id ORDER BY off, res_id) AS pe FROM {res}) t GROUP BY alloc_id""",
)
sql(
    "a06_a08_resource_sizes",
    """SELECT alloc_id, max(rsize) AS largest, min(rsize) AS smallest, CAST(round(stddev_pop(rsize)) AS BIGINT) AS deviation FROM {res} WHERE usage <> 2 GROUP BY alloc_id""",
)

# --- joins ---------------------------------------------------------------------------------

_STREAMS = "SELECT ts, pid % 8 AS stream, seq FROM {toks} WHERE pid % 2 = 0 UNION ALL SELECT ts, pid % 8, seq FROM {toks} WHERE pid % 2 = 1"
sql(
    "j01_u01_merged_streams",  # numbered within days, with the number of rows of all days before
    f"""WITH merged AS (SELECT ts // 86400 AS chunk, ts, stream, seq FROM ({_STREAMS}) u), offsets AS ({_BEFORE} FROM (SELECT chunk, count(*) AS total FROM merged GROUP BY chunk) c)
SELECT CAST(before + k AS BIGINT) AS n, ts, stream, seq FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY ts, stream, seq) AS k FROM merged) m JOIN offsets o ON o.chunk = m.chunk""",
    f"SELECT row_number() OVER (ORDER BY ts, stream, seq) AS n, ts, stream, seq FROM ({_STREAMS}) u",
)


@frame("j02_r03_asof_owner", "SELECT seq, last_value(CASE WHEN kind = 12 THEN seq END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS created_by FROM {toks}")
def asof_owner(view):
    return intervals.asof_last(view("toks"), F.when(F.col("kind") == 12, F.col("seq")), ["pid"], ["seq"], "created_by").select("seq", "created_by")


_PROBES = "SELECT p_partkey AS probe, (p_partkey * 7919 % 150000) * 1048576 + (p_size * 12345) % 1048576 AS va FROM {part}"


@frame("j03_j04_point_in_interval", f"SELECT probe, va, alloc_id FROM ({_PROBES}) p JOIN {{allocs}} a ON p.va >= a.base AND p.va < a.base + a.size")
def point_in_interval(view):
    whole = view("SELECT alloc_id, base AS lo, base + size AS hi FROM {allocs}")
    return intervals.range_join(view(_PROBES), whole, "va", "lo", "hi", 1 << 20).select("probe", "va", "alloc_id")


#: What the physical address space is made of: the segments, and what none of them has.
_ZONES = """SELECT CASE heap WHEN 0 THEN 'local' WHEN 1 THEN 'invisible' ELSE 'host' END AS store, lo AS z_lo, hi AS z_hi FROM {segments}
UNION ALL SELECT 'none', z_lo, z_hi FROM (SELECT coalesce(lag(hi) OVER (ORDER BY lo), 0) AS z_lo, lo AS z_hi FROM {segments}) g WHERE z_lo < z_hi UNION ALL SELECT 'none', max(hi), 9223372036854775807 FROM {segments}"""
_STATE = f"""WITH m AS (SELECT alloc_id, p AS s, lead(p) OVER (PARTITION BY alloc_id ORDER BY p) AS e FROM (SELECT alloc_id, lo AS p FROM {{maps}} UNION SELECT alloc_id, hi FROM {{maps}}) q),
c AS (SELECT m.alloc_id, m.s, m.e, x.pa, x.unmap, x.lo, row_number() OVER (PARTITION BY m.alloc_id, m.s ORDER BY x.seq DESC) AS k FROM m JOIN {{maps}} x ON x.alloc_id = m.alloc_id AND x.lo <= m.s AND x.hi >= m.e WHERE m.e IS NOT NULL),
zones AS ({_ZONES}),
t AS (SELECT alloc_id, s, e, 'host' AS store FROM c WHERE k = 1 AND NOT unmap AND pa = 0 UNION ALL SELECT alloc_id, s + greatest(z_lo - p, 0), s + least(z_hi - p, e - s), store FROM (SELECT *, pa + s - lo AS p FROM c WHERE k = 1 AND NOT unmap AND pa <> 0) x JOIN zones ON p < z_hi AND z_lo < p + e - s)"""


STORES = ("local", "invisible", "host", "none")


def mapped_state(view, maps: str = "maps") -> DataFrame:
    """(alloc_id, lo, hi, store): the latest mapping of each range, by the segment that its physical address lies in; a mapping over several is cut at their edges."""
    last = intervals.last_writer(view(maps).select("alloc_id", "lo", "hi", "seq", "pa", "unmap"), ["alloc_id"])
    # A physical address of 0 is host memory, as a whole; with a zone of its own all goes through one join, so the state is worked out once.
    ranges = last.selectExpr("alloc_id", "_s", "_e - _s AS whole", "pa <> 0 AS is_placed", "if(pa = 0, 0L, pa + _s - lo) AS p")
    zones = F.broadcast(view(_ZONES).selectExpr("store", "z_lo", "z_hi", "true AS placed").unionByName(last.sparkSession.sql(f"SELECT 'host' AS store, 0L AS z_lo, {(1 << 63) - 1}L AS z_hi, false AS placed")))  # the format has 8 segments at most
    met = ranges.join(zones, F.expr("is_placed = placed AND p < z_hi AND z_lo < p + whole"))
    return met.selectExpr("alloc_id", "_s + greatest(z_lo - p, 0L) AS lo", "_s + least(z_hi - p, whole) AS hi", "store")


@frame("r12_p08_j16_page_table_state", _STATE + " SELECT alloc_id, s AS lo, e AS hi, store FROM t")
def page_table(view):
    return mapped_state(view)


def backing(view, ranges: DataFrame, key: str, maps: str = "maps", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, local, invisible, host, none): bytes of ranges (alloc_id, key, lo, hi, keep) by where they are mapped; those of one key add up, and each has a row."""
    own = list(dict.fromkeys(["alloc_id", key, "lo", "hi", *keep, "_row"]))
    numbered = ranges.where(F.col(key).isNotNull()).withColumn("_row", F.monotonically_increasing_id()).alias("a")
    met = numbered.join(mapped_state(view, maps).alias("b"), F.expr("a.alloc_id = b.alloc_id AND a.lo < b.hi AND b.lo < a.hi"), "left")
    under = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    sums = met.groupBy(*[F.col(f"a.{c}") for c in own]).agg(*[F.sum(F.when(F.col("store") == s, under).otherwise(0)).alias(s) for s in STORES])
    return sums.select(key, *keep, *[F.sum(s).over(Window.partitionBy(key)).alias(s) for s in STORES])


def _backing(ranges: str, key: str) -> str:
    sums = ", ".join(f"CAST(coalesce(sum(least(r.hi, t.e) - greatest(r.lo, t.s)) FILTER (WHERE store = '{s}'), 0) AS BIGINT) AS {s}" for s in STORES)
    return f"SELECT r.{key}, {sums} FROM ({ranges}) r LEFT JOIN t ON t.alloc_id = r.alloc_id AND r.lo < t.e AND t.s < r.hi GROUP BY r.{key}"


_WHOLE = {"res_id": "SELECT alloc_id, res_id, rsize, heap, off AS lo, off + rsize AS hi FROM {res}", "alloc_id": "SELECT alloc_id, size, heap, CAST(0 AS BIGINT) AS lo, size AS hi FROM {allocs}"}
_SHARES = "{whole} - local - invisible - host - none AS unmapped, local + invisible + host + none = {whole} AS all_mapped, local * 100 {div} {whole} AS local_percent, invisible * 100 {div} {whole} AS invisible_percent, host * 100 {div} {whole} AS host_percent"


def _register_backing(name: str, key: str, whole: str) -> None:
    @frame(name, _STATE + f", o AS ({_backing(_WHOLE[key], key)}) SELECT o.*, {_SHARES.format(whole=whole, div='//')} FROM o JOIN ({_WHOLE[key]}) w ON w.{key} = o.{key}")
    def query(view):
        return backing(view, view(_WHOLE[key]), key, keep=(whole,)).selectExpr(key, *STORES, *_SHARES.format(whole=whole, div="div").split(", "))


_register_backing("j06_a14_f18_p38_backing_bytes", "res_id", "rsize")
_register_backing("a14_f18_p38_allocation_backing", "alloc_id", "size")
_IN_PREFERRED = "CASE heap WHEN 0 THEN local WHEN 1 THEN invisible WHEN 2 THEN host ELSE none END"


@frame("f19_in_preferred_heap", _STATE + f", o AS ({_backing(_WHOLE['res_id'], 'res_id')}) SELECT w.res_id, heap = 3 OR {_IN_PREFERRED} = rsize AS preferred FROM ({_WHOLE['res_id']}) w JOIN o ON o.res_id = w.res_id")
def in_preferred_heap(view):
    """All of a resource is mapped, and in the heap that its allocation prefers; without a preference it always is."""
    return backing(view, view(_WHOLE["res_id"]), "res_id", keep=("heap", "rsize")).selectExpr("res_id", f"heap = 3 OR {_IN_PREFERRED} = rsize AS preferred")


sql(
    "j05_equi_join",
    "SELECT r.res_id, a.alloc_id, a.base + r.off AS address, r.off AS offset_in_allocation FROM {res} r JOIN {allocs} a ON a.alloc_id = r.alloc_id",
    "SELECT res_id, alloc_id, alloc_id * 1048576 + off AS address, off AS offset_in_allocation FROM {res}",
)
sql(
    "j08_j10_u03_u04_f07_compare",
    f"""SELECT coalesce(d.res_id, b.res_id) AS res_id, CASE WHEN b.res_id IS NOT NULL AND d.res_id IS NOT NULL THEN 1 WHEN b.res_id IS NOT NULL THEN 2 ELSE 4 END AS compare_id, coalesce(d.rsize, b.rsize) AS bytes
FROM {at(BEFORE, "res")} b FULL OUTER JOIN {at(AFTER, "res")} d ON b.res_id = d.res_id""",
)
sql("j09_semi_join", "SELECT a.alloc_id, a.base FROM {allocs} a WHERE a.alloc_id IN (SELECT alloc_id FROM {res} WHERE usage = 12)")
sql("j10_f12_anti_join", "SELECT r.res_id FROM {res} r WHERE NOT EXISTS (SELECT 1 FROM {names} n WHERE n.res_id = r.res_id AND n.name = 'n7')")
sql(
    "j11_paired_heap",
    """SELECT h.alloc_id, h.res_id AS heap_id, o.res_id AS paired_id FROM (SELECT alloc_id, min(res_id) AS res_id FROM {res} WHERE usage = 2 AND off = 0 GROUP BY alloc_id) h
JOIN (SELECT alloc_id, min(res_id) AS res_id FROM {res} WHERE usage IN (3, 5) AND off = 0 GROUP BY alloc_id) o ON o.alloc_id = h.alloc_id""",
)
sql("j13_name_as_of", "SELECT res_id, coalesce(max_by(name, t) FILTER (WHERE t >= created AND t <= 5000), min_by(name, t) FILTER (WHERE t >= created)) AS name FROM {names} GROUP BY res_id")
sql("j14_r09_updates", "SELECT res_id, usage AS before_usage, CASE WHEN res_id % 5 = 0 AND usage = 3 THEN 4 ELSE usage END AS after_usage FROM {res}")
sql("j15_address_list", "SELECT a.alloc_id, p.va FROM {allocs} a JOIN (SELECT 1048576 * 7 + 100 AS va UNION ALL SELECT 1048576 * 1000 + 4096 UNION ALL SELECT 5) p ON p.va >= a.base AND p.va < a.base + a.size")

# --- replay --------------------------------------------------------------------------------

sql("r01_f16_f13_live_allocations", f"SELECT alloc_id, base, size, heap FROM {at(NOW)} a")
sql("r02_dangling_resources", f"SELECT res_id, alloc_id FROM {{res}} WHERE bind_ts <= {NOW} AND free_ts <= {NOW}")
sql(
    "r03_r04_episodes",
    "SELECT pid, seq AS created, lead(seq) OVER (PARTITION BY pid ORDER BY seq) AS replaced FROM {toks} WHERE kind = 12",
)
sql(
    "r05_r06_bindings",
    """SELECT alloc_id, off, CASE WHEN rebindable THEN last_id ELSE first_id END AS bound_id FROM (
SELECT alloc_id, off, bool_or(usage IN (2, 3, 9)) AS rebindable, max_by(res_id, bind_ts * 1000000 + res_id % 64) AS last_id, min_by(res_id, bind_ts * 1000000 + res_id % 64) AS first_id FROM {res} GROUP BY alloc_id, off) t""",
)
sql("r07_synthetic_allocations", "SELECT p.probe, p.va, 4096 AS size FROM (" + _PROBES + ") p LEFT JOIN {allocs} a ON a.alloc_id = p.va // 1048576 AND p.va < a.base + a.size WHERE a.alloc_id IS NULL")
sql("r08_sparse_commit", "SELECT a.alloc_id, CASE WHEN s.alloc_id IS NULL THEN a.heap ELSE 3 END AS heap FROM {allocs} a LEFT JOIN (SELECT DISTINCT alloc_id FROM {res} WHERE usage = 5 AND res_id % 11 = 0) s ON s.alloc_id = a.alloc_id")
sql("r13_r15_tokens_without_state", "SELECT kind, count(*) AS n FROM {toks} WHERE kind NOT IN (11, 12) GROUP BY kind")
sql("r14_f15_processes", "SELECT DISTINCT pid FROM {toks} WHERE kind = 12")
sql("r20_solitary_heaps", "SELECT alloc_id, res_id, CASE WHEN usage = 2 AND count(*) OVER (PARTITION BY alloc_id) <= 1 THEN 3 ELSE usage END AS usage FROM {res}")
sql("r21_r22_attached", f"SELECT r.res_id, r.alloc_id, a.alloc_id IS NULL AS dangling FROM {{res}} r LEFT JOIN {at(NOW)} a ON a.alloc_id = r.alloc_id WHERE r.bind_ts <= {NOW}")
sql("r26_commit_type", "SELECT res_id, CASE WHEN count(CASE WHEN usage <> 2 THEN 1 END) OVER (PARTITION BY alloc_id) <= 1 THEN 'COMMITTED' ELSE 'PLACED' END AS commit_type FROM {res}")
sql(
    "r28_p20_allocation_name",
    """SELECT a.alloc_id, CASE WHEN h.n = 1 THEN 'h' || CAST(h.id AS STRING) WHEN o.n = 1 THEN 'r' || CAST(o.id AS STRING) END AS name FROM {allocs} a
LEFT JOIN (SELECT alloc_id, count(*) AS n, max(res_id) AS id FROM {res} WHERE usage = 2 GROUP BY alloc_id) h ON h.alloc_id = a.alloc_id
LEFT JOIN (SELECT alloc_id, count(*) AS n, max(res_id) AS id FROM {res} WHERE usage <> 2 AND off = 0 GROUP BY alloc_id) o ON o.alloc_id = a.alloc_id""",
)

# --- replay of tokens ----------------------------------------------------------------------

#: The same replay told token by token: a recursive step for each token of an arena, and of a resource, with the state in its row.
_SHARED = """shared AS (SELECT b.trace_id, b.seq, b.ts, 12 AS kind, b.va, b.size // 4096 * 4096 AS size, b.heap, 1 AS made FROM {tape} b JOIN {tape} c ON c.kind = 13 AND c.trace_id = b.trace_id AND c.driver_id = b.driver_id AND c.seq < b.seq
  WHERE b.kind = 7 AND NOT (b.is_system AND b.va = 0) AND c.resource_type = 0 AND (c.create_flags & 4) <> 0 AND NOT EXISTS (SELECT 1 FROM {tape} x WHERE x.trace_id = b.trace_id AND x.driver_id = b.driver_id AND x.seq > c.seq AND x.seq < b.seq AND x.kind IN (7, 13, 15)))"""
_FOLD = """ev AS (SELECT *, row_number() OVER (PARTITION BY trace_id, va // 16777216 ORDER BY seq) AS k FROM (SELECT trace_id, seq, ts, kind, va, size, heap, 0 AS made FROM {tape} WHERE kind IN (11, 12) UNION ALL SELECT * FROM shared) u),
fold AS (SELECT DISTINCT trace_id, va // 16777216 AS arena, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(lo BIGINT, hi BIGINT, seq BIGINT)[]) AS live, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS held, CAST(NULL AS BIGINT) AS closes FROM ev
  UNION ALL SELECT e.trace_id, f.arena, e.k,
    CASE WHEN e.kind = 11 THEN list_filter(f.live, lambda x: x.lo <> e.va) WHEN len(list_filter(f.live, lambda x: x.lo <= e.va AND e.va < x.hi)) > 0 THEN f.live ELSE list_append(f.live, {'lo': e.va, 'hi': e.va + e.size, 'seq': e.seq}) END, e.seq,
    len(list_filter(f.live, lambda x: x.lo <= e.va AND e.va < x.hi)) > 0, CASE WHEN e.kind = 11 THEN list_filter(f.live, lambda x: x.lo = e.va)[1].seq END
  FROM fold f JOIN ev e ON e.trace_id = f.trace_id AND e.va // 16777216 = f.arena AND e.k = f.k + 1),
held AS (SELECT e.trace_id, e.seq, e.ts, e.va, e.size, e.heap, e.made, f.held, c.seq AS ends, c.ts AS free_ts FROM ev e JOIN fold f ON f.seq = e.seq AND f.trace_id = e.trace_id LEFT JOIN (SELECT g.trace_id, g.closes, g.seq, t.ts FROM fold g JOIN {tape} t ON t.seq = g.seq WHERE g.closes IS NOT NULL) c ON c.closes = e.seq WHERE e.kind = 12)"""
_STATES = """found AS (SELECT b.trace_id, b.seq, max(a.va) AS base FROM {tape} b JOIN held a ON NOT a.held AND a.trace_id = b.trace_id AND a.va <= b.va AND b.va < a.va + a.size AND a.seq <= b.seq AND (a.ends IS NULL OR b.seq < a.ends)
  WHERE b.kind = 7 AND NOT (b.is_system AND b.va = 0) GROUP BY b.trace_id, b.seq),
steps AS (SELECT t.*, f.base, row_number() OVER (PARTITION BY t.trace_id, t.driver_id ORDER BY t.seq) AS k FROM {tape} t LEFT JOIN found f ON f.trace_id = t.trace_id AND f.seq = t.seq WHERE t.kind IN (1, 7, 13, 15)),
life AS (SELECT DISTINCT trace_id, driver_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS ts, false AS live, false AS changed, CAST(NULL AS INTEGER) AS resource_type, CAST(NULL AS INTEGER) AS flags, CAST(NULL AS INTEGER) AS create_flags, CAST(NULL AS BIGINT) AS create_ts,
    CAST(NULL AS BIGINT) AS bind_ts, CAST(NULL AS BIGINT) AS address, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS base FROM steps
  UNION ALL SELECT s.trace_id, s.driver_id, s.k, s.seq, s.ts, CASE s.kind WHEN 13 THEN true WHEN 15 THEN false ELSE l.live END,
    s.kind = 13 OR l.live AND (s.kind <> 7 OR l.base IS NULL OR l.resource_type IN (1, 11, 15)), CASE WHEN s.kind = 13 THEN s.resource_type ELSE l.resource_type END,
    CASE s.kind WHEN 13 THEN s.usage_flags WHEN 1 THEN s.after ELSE l.flags END, CASE WHEN s.kind = 13 THEN s.create_flags ELSE l.create_flags END,
    CASE WHEN s.kind = 13 OR s.kind = 7 AND l.base IS NOT NULL AND l.resource_type IN (1, 11, 15) THEN s.ts ELSE l.create_ts END,
    CASE WHEN s.kind = 13 THEN NULL WHEN s.kind <> 7 OR l.base IS NOT NULL AND l.resource_type NOT IN (1, 11, 15) THEN l.bind_ts WHEN l.base IS NOT NULL AND s.is_system AND s.va = 0 THEN NULL ELSE s.ts END,
    CASE WHEN s.kind = 13 THEN NULL WHEN s.kind <> 7 OR l.base IS NOT NULL AND l.resource_type NOT IN (1, 11, 15) THEN l.address WHEN l.base IS NOT NULL AND s.is_system AND s.va = 0 THEN NULL ELSE s.va END,
    CASE WHEN s.kind = 13 THEN NULL WHEN s.kind <> 7 OR l.base IS NOT NULL AND l.resource_type NOT IN (1, 11, 15) THEN l.size WHEN l.base IS NOT NULL AND s.is_system AND s.va = 0 THEN NULL ELSE s.size END,
    CASE WHEN s.kind = 13 THEN NULL WHEN s.kind <> 7 OR l.base IS NOT NULL AND l.resource_type NOT IN (1, 11, 15) THEN l.base ELSE s.base END
  FROM life l JOIN steps s ON s.trace_id = l.trace_id AND s.driver_id = l.driver_id AND s.k = l.k + 1),
states AS (SELECT *, lead(ts) OVER (PARTITION BY trace_id, driver_id ORDER BY seq) AS valid_to FROM life WHERE changed)"""


def tape(view) -> DataFrame:
    return view("tape").withColumn("pref", F.array("heap"))


@frame("r01_r02_replayed_allocations", f"WITH RECURSIVE {_SHARED}, {_FOLD} SELECT trace_id, va AS base, size, ts AS valid_from, free_ts AS valid_to FROM held WHERE NOT held")
def replayed_allocations(view):
    return replay.allocations(replay.with_shared(tape(view))).select("trace_id", "base", "size", "valid_from", "valid_to")


@frame("r01_replayed_rejects", f"WITH RECURSIVE {_SHARED}, {_FOLD} SELECT trace_id, va AS base, size, ts AS valid_from FROM held WHERE made = 0 AND held")
def replayed_rejects(view):
    both = replay.with_shared(tape(view))
    return replay.rejects(both).join(tape(view).where("kind = 12").select("trace_id", "offset"), ["trace_id", "offset"]).select("trace_id", "base", "size", "valid_from")


@frame(
    "r03_r09_replayed_resources",
    f"""WITH RECURSIVE {_SHARED}, {_FOLD}, {_STATES} SELECT trace_id, driver_id, ts AS valid_from, valid_to, resource_type, CASE resource_type WHEN 1 THEN CASE WHEN flags & 4096 <> 0 THEN 4 ELSE 3 END WHEN 0 THEN 5 WHEN 11 THEN 2 WHEN 15 THEN 9 ELSE 8 END AS usage,
create_ts, bind_ts, address, size, base FROM states WHERE live""",
)
def replayed_resources(view):
    return replay.spans(tape(view)).drop("create_flags", "alloc_seq", "create_seq")


@frame(
    "r07_r08_heap_changes",
    f"""WITH RECURSIVE {_SHARED}, {_FOLD}, {_STATES},
moves AS (SELECT a.trace_id, a.seq, min(s.bind_ts) AS moved FROM states s JOIN {{tape}} b ON b.trace_id = s.trace_id AND b.driver_id = s.driver_id AND b.kind = 7 AND b.ts = s.bind_ts AND b.va = s.address JOIN held a ON NOT a.held AND a.trace_id = s.trace_id AND a.va = s.base AND a.seq <= b.seq AND (a.ends IS NULL OR b.seq < a.ends)
  WHERE s.live AND s.resource_type = 0 AND (s.create_flags & 64) <> 0 GROUP BY a.trace_id, a.seq),
a AS (SELECT h.*, CASE WHEN made = 1 THEN 0 ELSE heap END AS first, moved FROM held h LEFT JOIN moves m ON m.trace_id = h.trace_id AND m.seq = h.seq WHERE NOT h.held)
SELECT trace_id, heap, CAST(sum(delta) AS BIGINT) AS bytes, count(*) AS changes FROM (SELECT trace_id, first AS heap, size AS delta FROM a UNION ALL SELECT trace_id, first, -size FROM a WHERE moved IS NOT NULL UNION ALL SELECT trace_id, 3, size FROM a WHERE moved IS NOT NULL
  UNION ALL SELECT trace_id, CASE WHEN moved IS NULL THEN first ELSE 3 END, -size FROM a WHERE ends IS NOT NULL) d GROUP BY trace_id, heap""",
)
def heap_changes(view):
    return replay.heap_changes(tape(view)).groupBy("trace_id", "heap").agg(F.sum("delta").alias("bytes"), F.count("*").alias("changes"))


@frame(
    "n01_n05_n07_replayed_names",
    """SELECT n.trace_id, n.driver_id, c.ts AS create_ts, n.ts - n.delay AS event_time, n.name FROM {tape} n JOIN {tape} c ON c.trace_id = n.trace_id AND c.driver_id = n.driver_id AND c.kind = 13 AND c.resource_type IN (0, 1, 11) AND c.ts <= n.ts - n.delay
WHERE n.kind = 4 AND n.ts >= n.delay AND NOT EXISTS (SELECT 1 FROM {tape} x WHERE x.trace_id = n.trace_id AND x.driver_id = n.driver_id AND x.kind IN (13, 15) AND x.seq > c.seq AND x.ts <= n.ts - n.delay)""",
)
def replayed_names(view):
    return replay.names(tape(view))


# --- aggregates ----------------------------------------------------------------------------

_COUNTS = "SELECT ts, sum(d) AS d FROM (SELECT alloc_ts AS ts, 1 AS d FROM {allocs} UNION ALL SELECT free_ts, -1 FROM {allocs} WHERE free_ts IS NOT NULL) e GROUP BY ts"
_PROFILE = "(SELECT count(*) FROM {allocs}) AS allocations, (SELECT count(*) FROM {res}) AS resources, (SELECT max(alloc_ts) FROM {allocs}) AS max_ts, (SELECT count(DISTINCT pid) FROM {toks}) AS processes"
sql(
    "a01_data_profile",
    f"""WITH changes AS ({_COUNTS}), offsets AS ({_BEFORE} FROM (SELECT ts // 3000 AS chunk, sum(d) AS total FROM changes GROUP BY 1) c),
live AS (SELECT max(before + run) AS most FROM (SELECT ts // 3000 AS chunk, sum(d) OVER (PARTITION BY ts // 3000 ORDER BY ts) AS run FROM changes) r JOIN offsets o ON o.chunk = r.chunk)
SELECT {_PROFILE}, (SELECT CAST(most AS BIGINT) FROM live) AS max_live""",
    f"SELECT {_PROFILE}, (SELECT max(live) FROM (SELECT CAST(sum(d) OVER (ORDER BY ts) AS BIGINT) AS live FROM ({_COUNTS}) s) l) AS max_live",
)
sql("a02_a10_bytes_per_heap", f"SELECT heap, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM {at(NOW)} a GROUP BY heap")
sql("a09_resources_per_usage", f"SELECT usage, count(*) AS n FROM {at(NOW, 'res')} r GROUP BY usage")
def heap_state(view, t: int) -> DataFrame:
    """Per preferred heap at t: allocations, their resources, bytes, and how many of these are bound; resources that are heaps bind none."""
    bound = intervals.islands(view(f"SELECT alloc_id, off AS lo, off + rsize AS hi FROM {at(t, 'res')} r WHERE usage <> 2"), ["alloc_id"])
    bound = bound.groupBy("alloc_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("bound"))
    held = view(f"SELECT alloc_id, count(*) AS n, count_if(usage <> 2) AS n_bound FROM {at(t, 'res')} r GROUP BY alloc_id")
    live = view(f"SELECT alloc_id, heap, size FROM {at(t)} a").join(bound, "alloc_id", "left").join(held, "alloc_id", "left").fillna(0)
    return live.groupBy("heap").agg(
        F.count("*").alias("allocations"), F.sum("n").alias("resources"), F.sum("n_bound").alias("non_heap_resources"), F.sum("size").alias("bytes"), F.sum("bound").alias("bound"), F.sum(F.col("size") - F.col("bound")).alias("unbound"), F.min("size").alias("least"), F.max("size").alias("most")
    )


def _heap_state(t: int) -> str:
    """The same: bound are the stretches between ends of ranges that some range spans."""
    r = at(t, "res")
    return f"""(SELECT a.heap, count(*) AS allocations, CAST(sum(coalesce(k.n, 0)) AS BIGINT) AS resources, CAST(sum(coalesce(k.n_bound, 0)) AS BIGINT) AS non_heap_resources, CAST(sum(a.size) AS BIGINT) AS bytes,
  CAST(sum(coalesce(b.bound, 0)) AS BIGINT) AS bound, CAST(sum(a.size - coalesce(b.bound, 0)) AS BIGINT) AS unbound, min(a.size) AS least, max(a.size) AS most
FROM {at(t)} a LEFT JOIN (SELECT alloc_id, count(*) AS n, count(*) FILTER (WHERE usage <> 2) AS n_bound FROM {r} x GROUP BY alloc_id) k ON k.alloc_id = a.alloc_id
LEFT JOIN (SELECT alloc_id, sum(width) AS bound FROM (SELECT DISTINCT g.alloc_id, g.s, g.e - g.s AS width
  FROM (SELECT alloc_id, p AS s, lead(p) OVER (PARTITION BY alloc_id ORDER BY p) AS e FROM (SELECT alloc_id, off AS p FROM {r} x WHERE usage <> 2 UNION SELECT alloc_id, off + rsize FROM {r} y WHERE usage <> 2) q) g
  JOIN {r} z ON z.usage <> 2 AND z.alloc_id = g.alloc_id AND z.off <= g.s AND z.off + z.rsize >= g.e) d GROUP BY alloc_id) b ON b.alloc_id = a.alloc_id GROUP BY a.heap)"""


#: Mappings that a snapshot knows of: those made until then for allocations that live.
_MAPS_NOW = f"SELECT m.* FROM {{maps}} m JOIN {at(NOW)} a ON a.alloc_id = m.alloc_id WHERE m.bind_ts <= {NOW}"
_STATE_NOW = f"WITH snap AS ({_MAPS_NOW}), " + _STATE.replace("{maps}", "snap")[5:]
_STORE_HEAP = "CASE store WHEN 'local' THEN 0 WHEN 'invisible' THEN 1 WHEN 'host' THEN 2 ELSE 3 END"
_COMMITTED = f"SELECT heap, CAST(sum(CASE WHEN unmap THEN lo - hi ELSE hi - lo END) AS BIGINT) AS committed FROM {{maps}} WHERE pa <> 0 AND bind_ts <= {NOW} GROUP BY heap"


@frame(
    "a13_p33_segment_status",
    _STATE_NOW + f""" SELECT h.heap, allocations, bytes AS requested, least, most, bytes // allocations AS mean, non_heap_resources AS resources, bound, coalesce(p.physical, 0) AS physical, coalesce(k.committed, 0) AS committed,
CASE WHEN bytes > coalesce(g.hi - g.lo, 4294967296) THEN 'Over' WHEN bytes > coalesce(g.hi - g.lo, 4294967296) * 8 // 10 THEN 'Close' ELSE 'Under' END AS subscription
FROM {_heap_state(NOW)} h LEFT JOIN (SELECT {_STORE_HEAP} AS heap, CAST(sum(e - s) AS BIGINT) AS physical FROM t GROUP BY 1) p ON p.heap = h.heap LEFT JOIN ({_COMMITTED}) k ON k.heap = h.heap LEFT JOIN {{segments}} g ON g.heap = h.heap""",
)
def segment_status(view):
    """Heaps without a segment of their own have the 4 GiB of the others."""
    physical = mapped_state(view, _MAPS_NOW).groupBy(F.expr(_STORE_HEAP).alias("heap")).agg(F.sum(F.col("hi") - F.col("lo")).alias("physical"))
    segments = view("SELECT heap, hi - lo AS whole FROM {segments}")
    rows = heap_state(view, NOW).join(physical, "heap", "left").join(view(_COMMITTED), "heap", "left").join(segments, "heap", "left")
    status = scalars.subscription(F.col("bytes"), F.coalesce("whole", F.lit(1 << 32)))
    return rows.select("heap", "allocations", F.col("bytes").alias("requested"), "least", "most", F.expr("bytes div allocations").alias("mean"), F.col("non_heap_resources").alias("resources"), "bound", F.coalesce("physical", F.lit(0)).alias("physical"), F.coalesce("committed", F.lit(0)).alias("committed"), status.alias("subscription"))


@frame(
    "a13_usage_bytes_per_segment",
    _STATE_NOW + f""" SELECT {_STORE_HEAP} AS heap, usage, CAST(sum(least(r.off + r.rsize, t.e) - greatest(r.off, t.s)) AS BIGINT) AS bytes
FROM {at(NOW, 'res')} r JOIN t ON t.alloc_id = r.alloc_id AND r.off < t.e AND t.s < r.off + r.rsize WHERE r.usage <> 2 GROUP BY 1, 2""",
)
def usage_bytes(view):
    ranges = view(f"SELECT alloc_id, usage, off AS lo, off + rsize AS hi FROM {at(NOW, 'res')} r WHERE usage <> 2")
    under = intervals.overlap_bytes(ranges, mapped_state(view, _MAPS_NOW), ["alloc_id"], "store")
    return under.groupBy(F.expr(_STORE_HEAP).alias("heap"), "usage").agg(F.sum("bytes").alias("bytes"))


sql(
    "a18_r25_summary",
    f"SELECT coalesce(min(base), 0) AS min_va, coalesce(max(base + size), 0) AS max_va, coalesce(min(alloc_ts), 0) AS first_ts, coalesce(max(alloc_ts), 0) AS last_ts, coalesce(min(size), 0) AS least, coalesce(max(size), 0) AS most FROM {at(NOW)} a",
)
_POINT = ("allocations", "resources", "total", "bound", "unbound", "committed_local", "committed_invisible", "committed_host")


@frame(
    "a19_r27_a25_snapshot_point",
    f"SELECT (SELECT count(*) FROM {at(NOW)} a) AS allocations, (SELECT count(*) FROM {at(NOW, 'res')} r) AS resources, (SELECT CAST(sum(size) AS BIGINT) FROM {at(NOW)} b) AS total, (SELECT CAST(sum(bound) AS BIGINT) FROM {_heap_state(NOW)} h) AS bound, (SELECT CAST(sum(unbound) AS BIGINT) FROM {_heap_state(NOW)} h) AS unbound, "
    + ", ".join(f"(SELECT CAST(coalesce(sum(committed), 0) AS BIGINT) FROM ({_COMMITTED}) k WHERE heap = {h}) AS committed_{n}" for h, n in enumerate(("local", "invisible", "host"))),
)
def snapshot_point(view):
    """One row, from a few rows of each heap."""
    heaps = heap_state(view, NOW).withColumnRenamed("bytes", "total").select(*_POINT[:5])
    committed = view(_COMMITTED).select(*[F.when(F.col("heap") == h, F.col("committed")).alias(f"committed_{n}") for h, n in enumerate(("local", "invisible", "host"))])
    return heaps.unionByName(committed, allowMissingColumns=True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _POINT])


sql("a20_p12_size_histogram", f"SELECT CASE WHEN s >> 19 > 0 THEN least(CAST(floor(log2(CAST(s >> 19 AS DOUBLE))) AS INT), 11) ELSE 0 END AS bucket, count(*) AS n FROM (SELECT size * 64 AS s FROM {at(NOW)} a) t GROUP BY 1")


def _bucket(size: str) -> str:
    return f"CASE WHEN {size} >> 19 > 0 THEN least(CAST(floor(log2(CAST({size} >> 19 AS DOUBLE))) AS INT), 11) ELSE 0 END"


def _maps_at(t: int) -> str:
    return _MAPS_NOW.replace(str(NOW), str(t))


def carousel(view, t: int) -> DataFrame:
    """(metric, item, value): what a carousel shows of a snapshot: resources by usage, bytes by preferred and by physical heap, allocations by size, and totals."""
    long = lambda df, metric, item, value: df.select(F.lit(metric).alias("metric"), item.cast("long").alias("item"), value.cast("long").alias("value"))
    heaps = heap_state(view, t)
    totals = heaps.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "bound", "unbound", "allocations")])
    stacked = totals.select(F.expr("stack(4, 0L, bytes, 1L, bound, 2L, unbound, 3L, allocations) AS (item, value)"))
    physical = mapped_state(view, _maps_at(t)).groupBy(F.expr(_STORE_HEAP).alias("heap")).agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    parts = [
        long(view(f"SELECT usage, count(*) AS n FROM {at(t, 'res')} r GROUP BY usage"), "usage", F.col("usage"), F.col("n")),
        long(heaps.where("heap < 3"), "requested", F.col("heap"), F.col("bytes")), long(physical.where("heap < 3"), "physical", F.col("heap"), F.col("n")),
        long(view(f"SELECT {_bucket('size * 64')} AS bucket, count(*) AS n FROM {at(t)} a GROUP BY 1"), "size bucket", F.col("bucket"), F.col("n")), long(stacked, "total", F.col("item"), F.col("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def _carousel(t: int, name: str) -> str:
    """CTEs that end in one of that name."""
    state = _STATE.replace("{maps}", f"{name}_maps")[5:]
    for cte in ("m", "c", "zones", "t"):
        state = re.sub(rf"\b{cte} AS \(", f"{name}_{cte} AS (", state)
    state = state.replace("FROM m JOIN", f"FROM {name}_m AS m JOIN").replace("FROM c WHERE", f"FROM {name}_c WHERE").replace("JOIN zones ON", f"JOIN {name}_zones ON")
    h = f"(SELECT * FROM {_heap_state(t)} h)"
    return f"""{name}_maps AS ({_maps_at(t)}), {state}, {name} AS (SELECT 'usage' AS metric, CAST(usage AS BIGINT) AS item, count(*) AS value FROM {at(t, 'res')} r GROUP BY usage UNION ALL SELECT 'requested', heap, bytes FROM {h} x WHERE heap < 3
UNION ALL SELECT 'physical', heap, CAST(sum(w) AS BIGINT) FROM (SELECT {_STORE_HEAP} AS heap, e - s AS w FROM {name}_t) y WHERE heap < 3 GROUP BY heap UNION ALL SELECT 'size bucket', {_bucket('size * 64')}, count(*) FROM {at(t)} a GROUP BY 2
UNION ALL SELECT 'total', unnest([0, 1, 2, 3]), unnest([CAST(coalesce(sum(bytes), 0) AS BIGINT), CAST(coalesce(sum(bound), 0) AS BIGINT), CAST(coalesce(sum(unbound), 0) AS BIGINT), CAST(coalesce(sum(allocations), 0) AS BIGINT)]) FROM {h} z)"""


@frame("a20_carousel", f"WITH {_carousel(NOW, 'now')} SELECT * FROM now")
def carousel_now(view):
    return carousel(view, NOW)


@frame(
    "a21_carousel_delta",
    f"""WITH {_carousel(BEFORE, 'base')}, {_carousel(AFTER, 'diff')}, b AS (SELECT coalesce(base.metric, diff.metric) AS metric, coalesce(base.item, diff.item) AS item, coalesce(base.value, 0) AS v0, coalesce(diff.value, 0) AS v1 FROM base FULL JOIN diff ON base.metric = diff.metric AND base.item = diff.item),
d AS (SELECT metric, item, CASE WHEN metric = 'total' AND item IN (0, 3) THEN greatest(v0, v1) ELSE v1 - v0 END AS value FROM b)
SELECT metric, item, value, CASE WHEN metric = 'usage' THEN CAST(row_number() OVER (PARTITION BY metric ORDER BY abs(value) DESC, item) AS INTEGER) END AS place FROM d""",
)
def carousel_delta(view):
    """From BEFORE to AFTER; of total bytes and allocations the greater of the two; usages are placed by how much they change."""
    from pyspark.sql.window import Window

    sides = [carousel(view, t).withColumnRenamed("value", v) for t, v in ((BEFORE, "v0"), (AFTER, "v1"))]
    both = sides[0].join(sides[1], ["metric", "item"], "full").fillna(0, ["v0", "v1"])
    value = F.when((F.col("metric") == "total") & F.col("item").isin(0, 3), F.greatest("v0", "v1")).otherwise(F.col("v1") - F.col("v0"))
    changed = both.select("metric", "item", value.alias("value"))
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.abs("value").desc(), "item"))  # a few rows
    return changed.withColumn("place", F.when(F.col("metric") == "usage", place))


_HEAP_METRICS = ("allocations", "resources", "bytes", "bound", "unbound")


def heap_delta(base: DataFrame, diff: DataFrame) -> DataFrame:
    """What changed per heap from base to diff; swapping the two swaps the signs."""
    signed = [df.select("heap", *[(F.col(c) * sign).alias(c) for c in _HEAP_METRICS]) for df, sign in ((base, -1), (diff, 1))]
    return signed[0].union(signed[1]).groupBy("heap").agg(*[F.sum(c).alias(c) for c in _HEAP_METRICS])


def _heap_delta(base: int, diff: int) -> str:
    return f"SELECT coalesce(b.heap, d.heap) AS heap, {', '.join(f'coalesce(d.{c}, 0) - coalesce(b.{c}, 0) AS {c}' for c in _HEAP_METRICS)} FROM {_heap_state(base)} b FULL OUTER JOIN {_heap_state(diff)} d ON b.heap = d.heap"


@frame("a22_heap_delta", _heap_delta(BEFORE, AFTER))
def heap_changes_between(view):
    return heap_delta(base=heap_state(view, BEFORE), diff=heap_state(view, AFTER))


@frame("u07_swapped_heap_delta", _heap_delta(AFTER, BEFORE))
def swapped_heap_delta(view):
    return heap_delta(base=heap_state(view, AFTER), diff=heap_state(view, BEFORE))


sql(
    "a23_leak_statistics",
    f"""SELECT compare_id, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT CASE WHEN b.res_id IS NOT NULL AND d.res_id IS NOT NULL THEN 1 WHEN b.res_id IS NOT NULL THEN 2 ELSE 4 END AS compare_id, coalesce(d.rsize, b.rsize) AS bytes
FROM {at(BEFORE, "res")} b FULL OUTER JOIN {at(AFTER, "res")} d ON b.res_id = d.res_id) c GROUP BY compare_id""",
)
sql("a24_filtered_footer", f"SELECT count(*) AS n, CAST(sum(rsize) AS BIGINT) AS bytes FROM {at(NOW, 'res')} r WHERE rsize BETWEEN 8192 AND 131072 AND usage IN (3, 5, 6)")
sql("a26_allocation_extremes", f"SELECT max(size) AS most, min(size) AS least FROM {at(NOW)} a")
#: A-28: bytes of a resource lie in the heap that is preferred; unspecified preferences always do.
_PREFERRED = "heap = 3 OR (NOT unmap AND pa <> 0 AND CASE WHEN pa < 8589934592 THEN 0 ELSE 1 END = heap)"
_BOXES = f"SELECT r.usage, a.heap, a.owner, m.preferred, r.rsize AS bytes FROM {at(NOW, 'res')} r JOIN {{allocs}} a ON a.alloc_id = r.alloc_id JOIN (SELECT res_id, {_PREFERRED} AS preferred FROM {{maps}}) m ON m.res_id = r.res_id UNION ALL SELECT 1, heap, owner, CAST(NULL AS BOOLEAN), size FROM {at(NOW)} x"
_KEYS = ("usage", "heap", "owner", "preferred")
sql(
    "a27_a28_u02_treemap",
    f"SELECT usage, heap, owner, preferred, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n FROM ({_BOXES}) t GROUP BY ROLLUP (usage, heap, owner, preferred)",
    " UNION ALL ".join(
        f"SELECT {', '.join(k if i < depth else f'NULL AS {k}' for i, k in enumerate(_KEYS))}, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n FROM ({_BOXES}) t {'GROUP BY ' + ', '.join(_KEYS[:depth]) if depth else ''}"
        for depth in range(5)
    ),
)

#: What a treemap nests: resources by their adjusted size, and what allocations have unbound as rows of usage 1 without a resource's own keys.
_TREE_KEYS = {"heap_commit_usage": ("heap", "commit_type", "usage"), "ages_owner": ("alloc_age", "bind_age", "owner"), "mapped_preferred": ("cpu_mapped", "preferred", "heap")}


def _tree_boxes(view) -> DataFrame:
    ranges = view(f"SELECT alloc_id, res_id, usage, rsize, off AS lo, off + rsize AS hi FROM {at(NOW, 'res')} r WHERE usage <> 2")
    sizes = intervals.winners(ranges, ["alloc_id"], [F.col("usage").desc(), F.col("rsize"), F.col("res_id").desc()]).groupBy("res_id").agg(F.sum("width").alias("bytes"))
    live = view(f"SELECT alloc_id, heap, owner, size, alloc_ts FROM {at(NOW)} a")
    ends = live.agg(F.min("alloc_ts").alias("lo"), F.max("alloc_ts").alias("hi"))
    mapped = view(f"SELECT DISTINCT pid AS alloc_id, true AS cpu_mapped FROM {{toks}} WHERE kind = 10 AND ts <= {NOW}")
    allocs = live.crossJoin(F.broadcast(ends)).select("alloc_id", "heap", "owner", "size", scalars.age_bucket(F.col("alloc_ts"), F.col("lo"), F.col("hi")).alias("alloc_age"))  # ends: one row
    allocs = allocs.join(mapped, "alloc_id", "left").withColumn("cpu_mapped", F.coalesce("cpu_mapped", F.lit(False)))
    res = view(f"SELECT alloc_id, res_id, usage, bind_ts, count(*) OVER (PARTITION BY alloc_id) AS n FROM {at(NOW, 'res')} r WHERE usage <> 2")
    bound = res.crossJoin(F.broadcast(res.agg(F.min("bind_ts").alias("lo"), F.max("bind_ts").alias("hi"))))
    bound = bound.select("alloc_id", "res_id", "usage", scalars.age_bucket(F.col("bind_ts"), F.col("lo"), F.col("hi")).alias("bind_age"), F.when(F.col("n") == 1, "COMMITTED").otherwise("PLACED").alias("commit_type"))
    # All that a resource's adjusted size comes to is mapped in the heap that is preferred.
    mapped_bytes = backing(view, ranges, "res_id", _MAPS_NOW).withColumnRenamed("local", "_local")
    boxes = bound.join(sizes, "res_id", "left").join(mapped_bytes, "res_id").join(allocs, "alloc_id").withColumn("preferred", F.expr(_IN_PREFERRED.replace("local", "_local") + " = coalesce(bytes, 0L)"))
    keys = ["usage", "heap", "owner", "alloc_age", "cpu_mapped", "bind_age", "commit_type", "preferred"]
    gaps = intervals.gaps(intervals.islands(ranges, ["alloc_id"]), live, ["alloc_id"], "size").join(allocs, "alloc_id").select(F.lit(1).alias("usage"), *keys[1:5], (F.col("hi") - F.col("lo")).alias("bytes"))
    return boxes.select(*keys, F.coalesce("bytes", F.lit(0)).alias("bytes")).unionByName(gaps, allowMissingColumns=True)


def _tree_age(ts: str, rows: str) -> str:
    w = f"((SELECT max({ts}) FROM {rows} x) - (SELECT min({ts}) FROM {rows} x)) // 10"
    return f"CAST(CASE WHEN {w} = 0 THEN -1 ELSE least(greatest(({ts} - (SELECT min({ts}) FROM {rows} x)) // nullif({w}, 0), 0), 9) END AS INTEGER)"


_TREE_SQL = f"""r AS (SELECT * FROM {at(NOW, 'res')} q WHERE usage <> 2),
segs AS (SELECT * FROM (SELECT alloc_id, p AS s, lead(p) OVER (PARTITION BY alloc_id ORDER BY p) AS e FROM (SELECT alloc_id, off AS p FROM r UNION SELECT alloc_id, off + rsize FROM r UNION SELECT alloc_id, 0 FROM {at(NOW)} x UNION SELECT alloc_id, size FROM {at(NOW)} y) q) z WHERE e IS NOT NULL),
over_segs AS (SELECT g.alloc_id, g.e - g.s AS width, r.res_id, row_number() OVER (PARTITION BY g.alloc_id, g.s ORDER BY r.usage DESC, r.rsize, r.res_id DESC) AS k FROM segs g LEFT JOIN r ON r.alloc_id = g.alloc_id AND r.off <= g.s AND r.off + r.rsize >= g.e),
sizes AS (SELECT res_id, sum(width) AS bytes FROM over_segs WHERE k = 1 AND res_id IS NOT NULL GROUP BY res_id),
al AS (SELECT *, {_tree_age('alloc_ts', at(NOW))} AS alloc_age, alloc_id IN (SELECT pid FROM {{toks}} WHERE kind = 10 AND ts <= {NOW}) AS cpu_mapped FROM {at(NOW)} a),
boxes AS (SELECT r.usage, al.heap, al.owner, al.alloc_age, al.cpu_mapped, {_tree_age('bind_ts', 'r')} AS bind_age, CASE WHEN n.n = 1 THEN 'COMMITTED' ELSE 'PLACED' END AS commit_type, CASE al.heap WHEN 0 THEN b.local WHEN 1 THEN b.invisible WHEN 2 THEN b.host ELSE b.none END = coalesce(sizes.bytes, 0) AS preferred, coalesce(sizes.bytes, 0) AS bytes
  FROM r JOIN al ON al.alloc_id = r.alloc_id JOIN (SELECT alloc_id, count(*) AS n FROM r GROUP BY alloc_id) n ON n.alloc_id = r.alloc_id LEFT JOIN sizes ON sizes.res_id = r.res_id JOIN ({_backing("SELECT alloc_id, res_id, off AS lo, off + rsize AS hi FROM r", "res_id")}) b ON b.res_id = r.res_id
  UNION ALL SELECT 1, heap, owner, alloc_age, cpu_mapped, NULL, NULL, NULL, width FROM (SELECT alloc_id, sum(width) AS width FROM over_segs WHERE res_id IS NULL GROUP BY alloc_id) g JOIN al ON al.alloc_id = g.alloc_id)"""


def _register_tree(name: str, keys: tuple[str, ...]) -> None:
    levels = " UNION ALL ".join(f"SELECT {', '.join(k if i < depth else f'NULL AS {k}' for i, k in enumerate(keys))}, {depth} AS depth, CAST(sum(bytes) AS BIGINT) AS bytes FROM boxes {'GROUP BY ' + ', '.join(keys[:depth]) if depth else ''}" for depth in range(len(keys) + 1))

    @frame(f"a27_a28_treemap_{name}", f"{_STATE_NOW}, {_TREE_SQL} {levels}")
    def tree(view):
        # A level's number is that of its keys; grouping_id has a bit for each key that is not one.
        depth = F.lit(len(keys)) - F.expr("bit_count(grouping_id())").cast("int")
        return _tree_boxes(view).rollup(*keys).agg(depth.alias("depth"), F.sum("bytes").alias("bytes"))


for _name, _keys in _TREE_KEYS.items():
    _register_tree(_name, _keys)

# --- filters -------------------------------------------------------------------------------

sql("f01_f09_size_between", "SELECT alloc_id, size FROM {allocs} WHERE size BETWEEN 65536 AND 524288")
sql("f02_f08_substring_search", "SELECT p_partkey, p_name FROM {part} WHERE contains(lower(p_name), 'a1') OR contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'steel')")
_SEARCHES = "SELECT '0x700064' AS asked UNION ALL SELECT '7340132' UNION ALL SELECT '1001' UNION ALL SELECT '3f' UNION ALL SELECT 'none'"


@frame(
    "f03_address_search",  # hexadecimal with its prefix, else decimal; the address as text in any case
    f"""SELECT asked, alloc_id, base FROM (SELECT asked, CASE WHEN regexp_full_match(asked, '0x[0-9a-f]+|[0-9]+') THEN CAST(asked AS BIGINT) END AS va FROM ({_SEARCHES}) q) s
JOIN {{allocs}} a ON (s.va >= a.base AND s.va < a.base + a.size) OR contains('0x' || lower(to_hex(a.base)), asked)""",
)
def address_search(view):
    """One scan: each row meets the few strings that were asked for, as an array in its row."""
    asked = view(_SEARCHES).agg(F.collect_list("asked").alias("asked"))  # what a user typed: one row
    va = F.expr("CASE WHEN x RLIKE '^0x[0-9a-f]+$' THEN CAST(conv(substring(x, 3), 16, 10) AS BIGINT) WHEN x RLIKE '^[0-9]+$' THEN CAST(x AS BIGINT) END")
    rows = view("allocs").select("alloc_id", "base", "size", F.concat(F.lit("0x"), F.lower(F.hex("base"))).alias("text"))
    each = rows.crossJoin(F.broadcast(asked)).withColumn("x", F.explode("asked")).withColumn("va", va)
    return each.where("va >= base AND va < base + size OR contains(text, x)").select(F.col("x").alias("asked"), "alloc_id", "base")

sql("f04_f05_f06_categories", "SELECT res_id, heap, usage FROM {res} WHERE heap IN (0, 2) AND (CAST(1 AS INT) << usage) & 104 <> 0")


@frame(
    "f10_overview_filter",
    f"""WITH r AS (SELECT * FROM {at(NOW, 'res')} q WHERE usage <> 2), g AS (SELECT alloc_id, p AS s, lead(p) OVER (PARTITION BY alloc_id ORDER BY p) AS e FROM (SELECT alloc_id, off AS p FROM r UNION SELECT alloc_id, off + rsize FROM r) q),
w AS (SELECT r.res_id, g.e - g.s AS width, row_number() OVER (PARTITION BY g.alloc_id, g.s ORDER BY r.usage DESC, r.rsize, r.res_id DESC) AS k FROM g JOIN r ON r.alloc_id = g.alloc_id AND r.off <= g.s AND r.off + r.rsize >= g.e WHERE g.e IS NOT NULL)
SELECT r.res_id, CAST(sum(w.width) AS BIGINT) AS adjusted FROM r JOIN w ON w.res_id = r.res_id AND w.k = 1 WHERE r.heap = 1 AND r.usage IN (5, 6) GROUP BY r.res_id HAVING sum(w.width) >= 16384""",
)
def overview_filter(view):
    """Resources by the heap of their allocation (preferred and, as it is bound, actual), usage, and adjusted size."""
    ranges = view(f"SELECT alloc_id, res_id, usage, rsize, heap, off AS lo, off + rsize AS hi FROM {at(NOW, 'res')} r WHERE usage <> 2")
    sizes = intervals.winners(ranges, ["alloc_id"], [F.col("usage").desc(), F.col("rsize"), F.col("res_id").desc()]).where("heap = 1 AND usage IN (5, 6)")
    return sizes.groupBy("res_id").agg(F.sum("width").alias("adjusted")).where("adjusted >= 16384")


sql(
    "f11_visible_items",
    f"SELECT a.alloc_id, a.size FROM {at(NOW)} a JOIN (SELECT heap, sum(size) AS whole FROM {at(NOW)} x GROUP BY heap) h ON h.heap = a.heap WHERE a.size * 1000000 >= 4 * h.whole",
    f"SELECT alloc_id, size FROM (SELECT alloc_id, size, sum(size) OVER (PARTITION BY heap) AS whole FROM {at(NOW)} a) t WHERE size * 1000000 >= 4 * whole",
)
sql("f14_table_updates", "SELECT res_id, pa FROM {maps} WHERE NOT unmap AND pa <> 0")
sql("f17_series_mask", f"SELECT max(bytes) AS most FROM (SELECT heap, sum(size) AS s, CAST(sum(size) AS BIGINT) AS bytes FROM {at(NOW)} a WHERE heap <> 3 GROUP BY heap) t")
sql("f20_lookup", "SELECT alloc_id, base, size FROM {allocs} WHERE alloc_id = 77")

# --- order and top-k -----------------------------------------------------------------------

sql("o01_resource_order", f"SELECT res_id, row_number() OVER (PARTITION BY alloc_id ORDER BY rsize DESC, CASE WHEN usage = 2 THEN 0 ELSE 1 END, res_id) AS n FROM {at(NOW, 'res')} r")
_LIVE = f"SELECT alloc_id, heap, size, alloc_ts FROM {at(NOW)} a"
sql(
    "o02_o05_allocation_order",  # numbered among rows of one size and of one stretch of time, with the number of rows before these
    f"""WITH live AS ({_LIVE}),
sizes AS (SELECT heap, size, sum(n) OVER (PARTITION BY heap ORDER BY size DESC) - n AS larger FROM (SELECT heap, size, count(*) AS n FROM live GROUP BY heap, size) s),
times AS (SELECT heap, chunk, sum(n) OVER (PARTITION BY heap ORDER BY chunk) - n AS older FROM (SELECT heap, alloc_ts // 3000 AS chunk, count(*) AS n FROM live GROUP BY heap, alloc_ts // 3000) s)
SELECT k.alloc_id, CAST(larger + by_size AS BIGINT) AS by_size, CAST(older + by_age AS BIGINT) AS by_age
FROM (SELECT *, row_number() OVER (PARTITION BY heap, size ORDER BY alloc_id) AS by_size, row_number() OVER (PARTITION BY heap, alloc_ts // 3000 ORDER BY alloc_ts, alloc_id) AS by_age FROM live) k
JOIN sizes s ON s.heap = k.heap AND s.size = k.size JOIN times t ON t.heap = k.heap AND t.chunk = k.alloc_ts // 3000""",
    f"SELECT alloc_id, row_number() OVER (PARTITION BY heap ORDER BY size DESC, alloc_id) AS by_size, row_number() OVER (PARTITION BY heap ORDER BY alloc_ts, alloc_id) AS by_age FROM ({_LIVE}) a",
)
_ALLOC_ROWS = f"""SELECT a.alloc_id, a.heap, a.size, a.alloc_ts, coalesce(r.n, 0) AS resources, coalesce(r.fragments, 0) AS fragments, coalesce(r.bytes, 0) AS resource_bytes FROM {at(NOW)} a
LEFT JOIN (SELECT alloc_id, count(*) AS n, CAST(sum(rsize) AS BIGINT) AS bytes, CAST(sum(CASE WHEN off <> pe THEN 1 ELSE 0 END) AS BIGINT) AS fragments FROM (SELECT *, lag(off + rsize, 1, 0) OVER (PARTITION BY alloc_id ORDER BY off, res_id) AS pe FROM {at(NOW, 'res')} x) y GROUP BY alloc_id) r ON r.alloc_id = a.alloc_id"""
DESCENDING = {1: "", -1: " DESC"}
#: Columns that allocations are sorted by: (ascending, width of a chunk of values).
_ORDERS = {"alloc_id": (1, 4096), "size": (-1, 65536), "alloc_ts": (1, 30_000), "resources": (-1, 1), "fragments": (-1, 1), "resource_bytes": (-1, 262_144)}


@frame(
    "o02_o05_allocation_ranks",
    f"SELECT alloc_id, {', '.join(f'row_number() OVER (PARTITION BY heap ORDER BY {c}{DESCENDING[sign]}, alloc_id) AS by_{c}' for c, (sign, _) in _ORDERS.items())} FROM ({_ALLOC_ROWS}) a",
)
def allocation_ranks(view):
    """Each allocation's place in its heap by every column; ties go by id. Places are running counts over chunks of values."""
    rows = view(_ALLOC_ROWS)
    for column, (sign, width) in _ORDERS.items():
        keyed = rows.withColumn("_key", F.col(column) * sign)
        rows = intervals.running(keyed, ["heap"], ["_key", "alloc_id"], F.expr(f"cast(floor(_key / {width}) AS long)"), {f"by_{column}": ("sum", F.lit(1))}).drop("_key")
    return rows.select("alloc_id", *[f"by_{c}" for c in _ORDERS])


sql("o03_largest_allocations", f"SELECT alloc_id, size FROM {at(NOW)} a ORDER BY size DESC, alloc_id LIMIT 50")
sql("o04_history_order", "SELECT seq, row_number() OVER (PARTITION BY pid ORDER BY kind, ts, seq) AS n FROM {toks}")
sql("o07_o08_address_order", "SELECT res_id, row_number() OVER (PARTITION BY alloc_id ORDER BY off, res_id) AS by_address, row_number() OVER (PARTITION BY alloc_id ORDER BY rsize DESC, res_id) AS by_size FROM {res}")


@frame(
    "o06_top_and_other",
    f"SELECT heap, label, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT heap, CASE WHEN k <= 5 THEN label ELSE 'Other' END AS label, bytes FROM (SELECT heap, 'u' || CAST(usage AS STRING) AS label, sum(rsize) AS bytes, row_number() OVER (PARTITION BY heap ORDER BY sum(rsize) DESC, 'u' || CAST(usage AS STRING)) AS k FROM {at(NOW, 'res')} r WHERE usage <> 2 GROUP BY heap, usage) t) x GROUP BY heap, label",
)
def top_and_other(view):
    summed = view(f"SELECT heap, 'u' || CAST(usage AS STRING) AS label, sum(rsize) AS bytes FROM {at(NOW, 'res')} r WHERE usage <> 2 GROUP BY heap, usage")
    return intervals.top_and_other(summed, ["heap"], "label", "bytes", 5)


@frame(
    "w13_lanes",
    """WITH RECURSIVE ev AS (SELECT alloc_id, res_id AS id, off AS lo, off + rsize AS hi, row_number() OVER (PARTITION BY alloc_id ORDER BY off, res_id) AS k FROM {res} WHERE usage <> 2),
fold AS (SELECT DISTINCT alloc_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ends, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi, CAST(NULL AS BIGINT) AS lane FROM ev
  UNION ALL SELECT alloc_id, k, list_concat(list_append(ends[:p - 1], hi), ends[p + 1:]), id, lo, hi, p - 1
  FROM (SELECT e.alloc_id, e.k, e.id, e.lo, e.hi, f.ends, coalesce(nullif(list_position(list_transform(f.ends, lambda x: x <= e.lo), true), 0), len(f.ends) + 1) AS p FROM fold f JOIN ev e ON e.alloc_id = f.alloc_id AND e.k = f.k + 1) s)
SELECT alloc_id, id, lo, hi, CAST(lane AS INTEGER) AS lane FROM fold WHERE id IS NOT NULL""",
)
def lanes(view):
    return intervals.lanes(view("SELECT alloc_id, res_id AS id, off AS lo, off + rsize AS hi FROM {res} WHERE usage <> 2"), "alloc_id", chunk=1 << 18)


@frame("o09_treemap_layout")
def treemap(view):
    """Heaps, in them owners, and in these the live allocations, in a view of 1000 x 1000."""
    return layout.nested(view(f"SELECT heap, owner, alloc_id, size FROM {at(NOW)} a"), ["heap", "owner", "alloc_id"])


# --- scalar functions ----------------------------------------------------------------------


def _case(code: str, names) -> str:
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    return f"CASE {code} {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in pairs)} ELSE 'Unknown' END"


@frame(
    "p01_p02_page_sizes",
    "SELECT res_id, b AS page, n * b AS bytes FROM (SELECT res_id, rsize // 4096 AS n, CASE res_id % 8 WHEN 1 THEN 4096 WHEN 2 THEN 65536 WHEN 3 THEN 262144 WHEN 4 THEN 1048576 WHEN 5 THEN 2097152 ELSE 0 END AS b FROM {res}) t",
)
def page_sizes(view):
    page = scalars.page_bytes(F.col("res_id") % 8)
    return view("res").select("res_id", page.alias("page"), (F.expr("rsize div 4096") * page).alias("bytes"))


@frame(
    "p03_p25_usage_and_flags",
    "SELECT res_id, CASE WHEN f = 4096 THEN 4 ELSE 3 END AS buffer_usage, CASE WHEN f & 1 <> 0 THEN 6 WHEN f & 2 <> 0 THEN 7 ELSE 5 END AS image_usage, CASE WHEN f = 0 THEN 'None' ELSE concat_ws(' | ', " + ", ".join(f"CASE WHEN f & {1 << k} <> 0 THEN '{n}' END" for k, n in enumerate(enums.BUFFER_USAGE)) + ") || ' (' || f || ')' END AS flags FROM (SELECT res_id, CASE WHEN res_id % 3 = 0 THEN 4096 WHEN res_id % 3 = 1 THEN 0 ELSE 192 + res_id % 16 END AS f FROM {res}) t",
)
def usage_and_flags(view):
    f = F.expr("CASE WHEN res_id % 3 = 0 THEN 4096 WHEN res_id % 3 = 1 THEN 0 ELSE 192 + res_id % 16 END")
    return view("res").select("res_id", scalars.buffer_usage(f).alias("buffer_usage"), scalars.image_usage(f, 1, 2).alias("image_usage"), scalars.flags_text(f).alias("flags"))


sql("p04_p05_p06_offsets_and_overlap", "SELECT res_id, coalesce(base + off - base, 0) AS offset_in_allocation, off < 65536 AND 4096 < off + rsize AND rsize > 0 AS overlaps FROM {res}")


@frame("p07_address_parts", "SELECT alloc_id, CAST((base >> 38) & 1023 AS INT) AS a, CAST((base >> 28) & 1023 AS INT) AS b, CAST((base >> 20) & 255 AS INT) AS c, CAST((base >> 12) & 255 AS INT) AS d FROM {allocs}")
def address_parts(view):
    return view("allocs").select("alloc_id", *[c.alias(n) for c, n in zip(scalars.radices(F.col("base")), "abcd", strict=True)])


@frame("p09_p10_p11_times", "SELECT alloc_id, CASE WHEN f >= 1000000 THEN CAST(alloc_ts * 1000 // (f // 1000000) AS BIGINT) END AS ns, alloc_ts // 3000 AS bucket FROM (SELECT *, CASE WHEN alloc_id % 5 = 0 THEN 999999 ELSE 10000000 END AS f FROM {allocs}) t")
def times(view):
    f = F.expr("CASE WHEN alloc_id % 5 = 0 THEN 999999 ELSE 10000000 END")
    return view("allocs").select("alloc_id", F.floor(scalars.nanoseconds(F.col("alloc_ts"), f)).cast("long").alias("ns"), F.expr(f"alloc_ts div {scalars.BUCKET}").alias("bucket"))


@frame("p13_age_buckets", f"SELECT alloc_id, CAST(CASE WHEN w = 0 THEN -1 ELSE least(greatest((alloc_ts - lo) // w, 0), 9) END AS INT) AS age FROM (SELECT alloc_id, alloc_ts, min(alloc_ts) OVER () AS lo, (max(alloc_ts) OVER () - min(alloc_ts) OVER ()) // 10 AS w FROM {at(NOW)} a) t")
def ages(view):
    live = view(f"SELECT alloc_id, alloc_ts FROM {at(NOW)} a")
    ends = F.broadcast(live.agg(F.min("alloc_ts").alias("lo"), F.max("alloc_ts").alias("hi")))
    return live.crossJoin(ends).select("alloc_id", scalars.age_bucket(F.col("alloc_ts"), F.col("lo"), F.col("hi")).alias("age"))


#: Each allocation with the step that a slider stands at.
_STEPS = "SELECT alloc_id, size, alloc_id % 26 AS step FROM {allocs}"


@frame("p14_slider_bounds", f"SELECT alloc_id, step, bytes, bytes IS NULL OR size <= bytes AS within FROM (SELECT *, CASE WHEN step = 0 THEN 0 WHEN step < 24 THEN CAST(pow(2, step + 7) AS BIGINT) END AS bytes FROM ({_STEPS}) s) t")
def slider(view):
    """The upper bound that a slider's step means for each allocation; the last steps are no bound."""
    rows = view(_STEPS).withColumn("bytes", scalars.slider_bytes(F.col("step")))
    return rows.selectExpr("alloc_id", "step", "bytes", "bytes IS NULL OR size <= bytes AS within")


@frame(
    "p15_p16_p18_texts",
    "SELECT alloc_id, CASE WHEN v < 1024 THEN format('{:,}', v) || ' bytes' WHEN v < 1048576 THEN format('{:,.2f}', v / 1024.0) || ' KiB' ELSE format('{:,.2f}', v / 1048576.0) || ' MiB' END AS memory, '0x' || lower(to_hex(base)) AS address, format('{:,}', base) AS plain FROM (SELECT alloc_id, base, CASE WHEN alloc_id % 3 = 0 THEN alloc_id % 1024 ELSE size + alloc_id % 4 * 256 END AS v FROM {allocs}) t",
)
def texts(view):
    v = F.expr("CASE WHEN alloc_id % 3 = 0 THEN alloc_id % 1024 ELSE size + alloc_id % 4 * 256 END")
    return view("allocs").select("alloc_id", scalars.memory_text(v).alias("memory"), scalars.hex_text(F.col("base")).alias("address"), F.format_number("base", 0).alias("plain"))


_MEMORY = "CASE WHEN {0} < 1024 THEN format('{{:,}}', {0}) || ' bytes' WHEN {0} < 1048576 THEN format('{{:,.2f}}', {0} / 1024.0) || ' KiB' ELSE format('{{:,.2f}}', {0} / 1048576.0) || ' MiB' END"


@frame("p18_size_ranges", f"SELECT alloc_id, {_MEMORY.format('lo')} || ' - ' || coalesce({_MEMORY.format('hi')}, '∞') AS text FROM (SELECT alloc_id, alloc_id % 2048 AS lo, CASE WHEN alloc_id % 4 <> 0 THEN size END AS hi FROM {{allocs}}) t")
def size_ranges(view):
    return view("allocs").select("alloc_id", scalars.range_text(F.col("alloc_id") % 2048, F.when(F.col("alloc_id") % 4 != 0, F.col("size"))).alias("text"))


@frame("p17_hash_text", "SELECT alloc_id, CASE WHEN h = 0 AND l = 0 THEN 'N/A' WHEN h = 0 THEN '0x' || lower(to_hex(l)) ELSE '0x' || lower(to_hex(h)) || lpad(lower(to_hex(l)), 16, '0') END AS hash FROM (SELECT alloc_id, alloc_id % 3 AS h, alloc_id % 5 * 1000 AS l FROM {allocs}) t")
def hash_text(view):
    return view("allocs").select("alloc_id", scalars.hash128_text(F.col("alloc_id") % 3, F.col("alloc_id") % 5 * 1000).alias("hash"))


sql("p19_p21_p22_names", "SELECT r.res_id, upper('Resource ' || CAST(r.res_id AS STRING)) AS name, CASE WHEN r.free_ts <= 1000000 THEN 'Orphaned' WHEN r.heap = 0 THEN 'Local' ELSE '-' END AS label FROM {res} r")


@frame("p23_p24_p27_p39_labels", f"SELECT r.res_id, {_case('r.usage', enums.USAGES)} AS usage_name, {_case('r.heap', enums.HEAPS)} AS heap_name, {_case('a.owner', enums.OWNERS)} AS owner_name, {_case('r.res_id % 12', enums.MEMORY_TYPES)} AS memory_type, {_case('r.res_id % 18', enums.RESOURCE_TYPES)} AS type_name FROM {{res}} r JOIN {{allocs}} a ON a.alloc_id = r.alloc_id")
def labels(view):
    rows = view("SELECT r.res_id, r.usage, r.heap, a.owner FROM {res} r JOIN {allocs} a ON a.alloc_id = r.alloc_id")
    return rows.select("res_id", enums.named(F.col("usage"), enums.USAGES).alias("usage_name"), enums.named(F.col("heap"), enums.HEAPS).alias("heap_name"), enums.named(F.col("owner"), enums.OWNERS).alias("owner_name"), enums.named(F.col("res_id") % 12, enums.MEMORY_TYPES).alias("memory_type"), enums.named(F.col("res_id") % 18, enums.RESOURCE_TYPES).alias("type_name"))


@frame("p26_swizzle", f"SELECT res_id, {_case('res_id % 6', enums.SWIZZLES)} || {_case('res_id % 5', enums.SWIZZLES)} AS swizzle FROM {{res}}")
def swizzle(view):
    return view("res").select("res_id", scalars.swizzle_text(F.col("res_id") % 6, F.col("res_id") % 5).alias("swizzle"))


@frame("p28_device_id", "SELECT alloc_id, to_hex(((29000 + alloc_id % 100) & 65535) << 8 | (alloc_id % 256)) AS device FROM {allocs}")
def device(view):
    return view("allocs").select("alloc_id", scalars.device_id((F.lit(29000) + F.col("alloc_id") % 100).cast("int"), (F.col("alloc_id") % 256).cast("int")).alias("device"))


#: Codes of images and flag words as the numbers of resources give them, past the end of each table too.
_NAMED = {"format": ("res_id % 192", enums.FORMATS), "image_type": ("res_id % 4", enums.IMAGE_TYPES), "tiling": ("res_id // 4 % 4", enums.TILINGS), "tiling_mode": ("res_id // 16 % 4", enums.TILING_MODES), "page_size": ("res_id % 7", enums.PAGE_SIZE_NAMES), "commit": ("res_id % 4", enums.COMMITS), "misc": ("res_id % 8", enums.MISC), "process_event": ("res_id % 3", enums.PROCESS_EVENTS), "table_update": ("res_id % 5", enums.TABLE_UPDATES), "token": ("res_id % 17", enums.TOKENS)}
_FLAGS = {"image_creation": enums.IMAGE_CREATION, "image_usage": enums.IMAGE_USAGE, "buffer_creation": enums.BUFFER_CREATION, "buffer_usage": enums.BUFFER_USAGE, "gpu_event": enums.GPU_EVENT, "pipeline_creation": enums.PIPELINE_CREATION, "command_allocator": enums.COMMAND_ALLOCATOR, "pipeline_stages": enums.PIPELINE_STAGES}


@frame("p24_enum_names", f"SELECT res_id, {', '.join(f'{_case(code, names)} AS {n}_name' for n, (code, names) in _NAMED.items())} FROM {{res}}")
def enum_names(view):
    return view("res").select("res_id", *[enums.named(F.expr(code.replace("//", "div")), names).alias(f"{n}_name") for n, (code, names) in _NAMED.items()])


@frame(
    "p25_flag_families",  # the word of a family has only bits that it names
    "SELECT res_id, " + ", ".join(f"coalesce(nullif((SELECT string_agg(n, ' | ' ORDER BY k) || ' (' || w || ')' FROM (SELECT unnest({list(names)}) AS n, unnest(range({len(names)})) AS k, (res_id * 7919) % {1 << len(names)} AS w) b WHERE (w >> k) & 1 = 1 GROUP BY w), ''), 'None') AS {f}" for f, names in _FLAGS.items()) + " FROM {res}",
)
def flag_families(view):
    return view("res").select("res_id", *[scalars.flags_text(F.expr(f"(res_id * 7919) % {1 << len(names)}"), names).alias(f) for f, names in _FLAGS.items()])


@frame("p31_name_key", "SELECT res_id, (coalesce(c, r) << 32) | (coalesce(r, c) % 4294967296) AS key FROM (SELECT res_id, CASE WHEN res_id % 3 <> 0 THEN res_id END AS r, CASE WHEN res_id % 5 <> 0 THEN res_id // 7 END AS c FROM {res}) t")
def name_key(view):
    rows = view("SELECT res_id, CASE WHEN res_id % 3 <> 0 THEN res_id END AS r, CASE WHEN res_id % 5 <> 0 THEN res_id // 7 END AS c FROM {res}")
    return rows.select("res_id", scalars.name_key(F.col("r"), F.col("c")).alias("key"))


_TAPE_EVENTS = {4: "name", 7: "bind", 11: "free", 12: "allocate", 13: "create", 15: "destroy"}


@frame(
    "p37_event_classes",
    f"""SELECT e.seq, e.event, x.class, x.shape FROM (SELECT seq, {_case('kind', _TAPE_EVENTS)} AS event FROM {{tape}} WHERE kind IN (4, 7, 11, 12, 13, 15) UNION ALL SELECT seq, CASE kind WHEN 6 THEN 'resident' ELSE 'cpu map' END FROM {{toks}} WHERE kind IN (6, 10)) e
LEFT JOIN (VALUES {', '.join(f"('{e}', '{c}', '{sh}')" for e, (c, sh) in enums.EVENTS.items())}) x(event, class, shape) ON x.event = e.event""",
)
def event_classes(view):
    tokens = view("SELECT seq, kind FROM {tape} WHERE kind IN (4, 7, 11, 12, 13, 15)").select("seq", enums.named(F.col("kind"), _TAPE_EVENTS).alias("event"))
    touched = view("SELECT seq, CASE kind WHEN 6 THEN 'resident' ELSE 'cpu map' END AS event FROM {toks} WHERE kind IN (6, 10)")
    return tokens.union(touched).withColumns({n: F.coalesce(*[F.when(F.col("event") == e, v[k]) for e, v in enums.EVENTS.items()]) for k, n in enumerate(("class", "shape"))})


_IMAGE = "usage IN (5, 6, 7)"
_FNV = "2166136261"
for _k in range(8):
    _FNV = f"(xor({_FNV}, (alloc_id >> {8 * _k}) & 255) * 16777619) & 4294967295" if _k == 0 else f"(xor(({_FNV}), (alloc_id >> {8 * _k}) & 255) * 16777619) & 4294967295"


@frame("p30_id_hash", f"SELECT alloc_id, CAST({_FNV} AS BIGINT) AS hash FROM {{allocs}}")
def id_hash(view):
    return view("allocs").select("alloc_id", scalars.fnv1a32(F.col("alloc_id")).alias("hash"))


sql(
    "p32_p34_p35_segments",  # with resizable memory the invisible segment is part of the local one, and preferences for it mean that
    """SELECT a.alloc_id, a.heap, CASE WHEN a.heap = 1 THEN 0 ELSE a.heap END AS preferred, a.heap IN (0, 1) AS in_video_memory, a.heap IN (0, 2) AS cpu_visible, a.heap = 2 AS cpu_cached, coalesce(s.bytes, 0) AS folded_bytes, coalesce(s.bytes, 0) > 0 AND a.heap IN (0, 1) AS gpu_local, v.total AS video_memory
FROM {allocs} a LEFT JOIN (SELECT CASE WHEN heap = 1 THEN 0 ELSE heap END AS heap, CAST(sum(hi - lo) AS BIGINT) AS bytes FROM {segments} GROUP BY 1) s ON s.heap = CASE WHEN a.heap = 1 THEN 0 ELSE a.heap END
CROSS JOIN (SELECT CAST(sum(hi - lo) AS BIGINT) AS total FROM {segments} WHERE heap IN (0, 1)) v""",
    """SELECT alloc_id, heap, [0, 0, 2, 3][heap + 1] AS preferred, heap < 2 AS in_video_memory, heap % 2 = 0 AS cpu_visible, heap = 2 AS cpu_cached, CASE WHEN heap < 2 THEN (SELECT CAST(sum(hi - lo) AS BIGINT) FROM {segments}) ELSE 0 END AS folded_bytes, heap < 2 AS gpu_local,
(SELECT CAST(max(hi) - min(lo) AS BIGINT) FROM {segments}) AS video_memory FROM {allocs}""",
)

# --- naming and histories ------------------------------------------------------------------

sql("n01_restamped", "SELECT res_id, name, t - 500 AS event_time FROM {names} WHERE t >= 500")
sql("n05_names_in_life", "SELECT res_id, t, name FROM {names} WHERE t >= created AND t < created + 1000")
sql("h08_typed_events", "SELECT kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(CASE WHEN kind = 12 THEN size END) AS largest FROM {toks} GROUP BY kind")


#: SQL for the check that says the same as a query above in another way.
_IN_OTHER_WORDS = {
    "w04_a11_a12_committed_bytes": "SELECT bucket, heap, CAST(sum(d) AS BIGINT) AS change FROM (SELECT bind_ts // 3000 AS bucket, heap, (hi - lo) * CASE WHEN unmap THEN -1 ELSE 1 END AS d FROM {maps} WHERE pa > 0) t GROUP BY ALL",
    "w09_stacked_share": f"WITH s AS (SELECT heap, list_position([2, 0, 1, 3], heap) AS pos, sum(size) AS bytes FROM {at(NOW)} a GROUP BY ALL) SELECT a.heap, CAST((SELECT sum(b.bytes) FROM s b WHERE b.pos <= a.pos) AS BIGINT) AS stacked, CAST((SELECT sum(bytes) FROM s) AS BIGINT) AS total FROM s a",
    "w10_w11_duplicate_events": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq) AS k FROM {toks}) SELECT t.seq, t.ts, t.kind, t.pid FROM n t WHERE NOT EXISTS (SELECT 1 FROM n f WHERE f.pid = t.pid AND f.k = t.k - 1 AND f.kind = t.kind AND f.ts // 3600 = t.ts // 3600)",
    "w14_unique_ids": "SELECT t.seq, (t.pid << 32) + (SELECT count(*) FROM {toks} x WHERE x.kind = 12 AND x.pid = t.pid AND x.seq < t.seq) AS unique_id FROM {toks} t WHERE t.kind = 12",
    "a07_fragmentation": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY alloc_id ORDER BY off, res_id) AS k FROM {res}) SELECT b.alloc_id, count(*) FILTER (WHERE b.off <> coalesce(a.off + a.rsize, 0)) AS fragments FROM n b LEFT JOIN n a ON a.alloc_id = b.alloc_id AND a.k = b.k - 1 GROUP BY b.alloc_id",
    "j08_j10_u03_u04_f07_compare": f"""WITH b AS (SELECT * FROM {at(BEFORE, "res")} x), d AS (SELECT * FROM {at(AFTER, "res")} x) SELECT res_id, 1 AS compare_id, rsize AS bytes FROM d WHERE res_id IN (SELECT res_id FROM b)
UNION ALL SELECT res_id, 2, rsize FROM b WHERE res_id NOT IN (SELECT res_id FROM d) UNION ALL SELECT res_id, 4, rsize FROM d WHERE res_id NOT IN (SELECT res_id FROM b)""",
    "j09_semi_join": "SELECT DISTINCT a.alloc_id, a.base FROM {allocs} a JOIN {res} r ON r.alloc_id = a.alloc_id AND r.usage = 12",
    "j10_f12_anti_join": "SELECT res_id FROM {res} EXCEPT SELECT res_id FROM {names} WHERE name = 'n7'",
    "j11_paired_heap": "WITH n AS (SELECT alloc_id, res_id, usage = 2 AS is_heap, row_number() OVER (PARTITION BY alloc_id, usage = 2 ORDER BY res_id) AS k FROM {res} WHERE off = 0 AND usage IN (2, 3, 5)) SELECT h.alloc_id, h.res_id AS heap_id, o.res_id AS paired_id FROM n h JOIN n o ON o.alloc_id = h.alloc_id AND h.is_heap AND NOT o.is_heap AND h.k = 1 AND o.k = 1",
    "j13_name_as_of": "SELECT res_id, name FROM (SELECT res_id, CASE WHEN t >= created THEN name END AS name, row_number() OVER (PARTITION BY res_id ORDER BY t < created, t > 5000, CASE WHEN t <= 5000 THEN -t ELSE t END) AS k FROM {names}) n WHERE k = 1",
    "j14_r09_updates": "SELECT res_id, usage AS before_usage, usage + CAST(usage = 3 AND res_id // 5 * 5 = res_id AS INTEGER) AS after_usage FROM {res}",
    "j15_address_list": "SELECT a.alloc_id, p.va FROM (SELECT unnest([7340132, 1048580096, 5]) AS va) p JOIN {allocs} a ON a.alloc_id = p.va // 1048576 AND p.va % 1048576 < a.size",
    "r01_f16_f13_live_allocations": f"SELECT alloc_id, base, size, heap FROM {{allocs}} WHERE alloc_ts <= {NOW} EXCEPT SELECT alloc_id, base, size, heap FROM {{allocs}} WHERE free_ts <= {NOW}",
    "r02_dangling_resources": f"SELECT r.res_id, a.alloc_id FROM {{allocs}} a JOIN {{res}} r ON r.alloc_id = a.alloc_id WHERE NOT (a.free_ts IS NULL OR a.free_ts > {NOW}) AND NOT r.bind_ts > {NOW}",
    "r03_r04_episodes": "SELECT t.pid, t.seq AS created, (SELECT min(x.seq) FROM {toks} x WHERE x.kind = 12 AND x.pid = t.pid AND x.seq > t.seq) AS replaced FROM {toks} t WHERE t.kind = 12",
    "r05_r06_bindings": "SELECT DISTINCT alloc_id, off, CASE WHEN max(CAST(usage IN (2, 3, 9) AS INTEGER)) OVER w = 1 THEN last_value(res_id) OVER o ELSE first_value(res_id) OVER o END AS bound_id FROM {res} WINDOW w AS (PARTITION BY alloc_id, off), o AS (PARTITION BY alloc_id, off ORDER BY bind_ts, res_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "r07_synthetic_allocations": "SELECT p.probe, p.va, 4096 AS size FROM (" + _PROBES + ") p WHERE NOT EXISTS (SELECT 1 FROM {allocs} a WHERE a.base <= p.va AND p.va < a.base + a.size)",
    "r08_sparse_commit": "SELECT alloc_id, CASE WHEN EXISTS (SELECT 1 FROM {res} r WHERE r.alloc_id = a.alloc_id AND r.usage = 5 AND r.res_id % 11 = 0) THEN 3 ELSE heap END AS heap FROM {allocs} a",
    "r13_r15_tokens_without_state": "SELECT DISTINCT kind, count(*) OVER (PARTITION BY kind) AS n FROM {toks} WHERE kind <> 11 AND kind <> 12",
    "r14_f15_processes": "SELECT pid FROM {toks} GROUP BY pid HAVING bool_or(kind = 12)",
    "r20_solitary_heaps": "SELECT r.alloc_id, r.res_id, CASE WHEN r.usage = 2 AND NOT EXISTS (SELECT 1 FROM {res} o WHERE o.alloc_id = r.alloc_id AND o.res_id <> r.res_id) THEN 3 ELSE r.usage END AS usage FROM {res} r",
    "r21_r22_attached": f"SELECT res_id, alloc_id, NOT EXISTS (SELECT 1 FROM {at(NOW)} a WHERE a.alloc_id = r.alloc_id) AS dangling FROM {{res}} r WHERE bind_ts <= {NOW}",
    "r26_commit_type": "SELECT r.res_id, CASE WHEN coalesce(c.n, 0) > 1 THEN 'PLACED' ELSE 'COMMITTED' END AS commit_type FROM {res} r LEFT JOIN (SELECT alloc_id, count(*) AS n FROM {res} WHERE usage <> 2 GROUP BY alloc_id) c ON c.alloc_id = r.alloc_id",
    "r28_p20_allocation_name": """WITH one AS (SELECT alloc_id, usage = 2 AS is_heap, any_value(res_id) AS id FROM {res} WHERE usage = 2 OR off = 0 GROUP BY ALL HAVING count(*) = 1)
SELECT a.alloc_id, coalesce((SELECT 'h' || CAST(id AS STRING) FROM one WHERE one.alloc_id = a.alloc_id AND is_heap), (SELECT 'r' || CAST(id AS STRING) FROM one WHERE one.alloc_id = a.alloc_id AND NOT is_heap)) AS name FROM {allocs} a""",
    "a02_a10_bytes_per_heap": f"SELECT h.heap, CAST(sum(CASE WHEN a.heap = h.heap THEN size END) AS BIGINT) AS bytes, count(CASE WHEN a.heap = h.heap THEN 1 END) AS n FROM (SELECT DISTINCT heap FROM {at(NOW)} x) h CROSS JOIN {at(NOW)} a GROUP BY h.heap",
    "a09_resources_per_usage": f"SELECT DISTINCT usage, count(*) OVER (PARTITION BY usage) AS n FROM {at(NOW, 'res')} r",
    "a18_r25_summary": f"WITH a AS (SELECT * FROM {at(NOW)} x) SELECT " + ", ".join(f"coalesce((SELECT {e} FROM a ORDER BY {e} {d} LIMIT 1), 0) AS {n}" for n, e, d in (("min_va", "base", ""), ("max_va", "base + size", "DESC"), ("first_ts", "alloc_ts", ""), ("last_ts", "alloc_ts", "DESC"), ("least", "size", ""), ("most", "size", "DESC"))),
    "a20_p12_size_histogram": f"SELECT CAST(least(greatest(length(bin(size * 64 // 524288)) - 1, 0), 11) AS INTEGER) AS bucket, count(*) AS n FROM {at(NOW)} a GROUP BY 1",
    "a23_leak_statistics": f"""WITH b AS (SELECT * FROM {at(BEFORE, "res")} x), d AS (SELECT * FROM {at(AFTER, "res")} x) SELECT 1 AS compare_id, count(*) AS n, CAST(sum(rsize) AS BIGINT) AS bytes FROM d WHERE res_id IN (SELECT res_id FROM b) HAVING count(*) > 0
UNION ALL SELECT 2, count(*), CAST(sum(rsize) AS BIGINT) FROM b WHERE res_id NOT IN (SELECT res_id FROM d) HAVING count(*) > 0 UNION ALL SELECT 4, count(*), CAST(sum(rsize) AS BIGINT) FROM d WHERE res_id NOT IN (SELECT res_id FROM b) HAVING count(*) > 0""",
    "a24_filtered_footer": f"SELECT count(*) FILTER (WHERE k) AS n, CAST(sum(rsize) FILTER (WHERE k) AS BIGINT) AS bytes FROM (SELECT rsize, NOT (rsize < 8192 OR rsize > 131072) AND (1 << usage) & 104 <> 0 AS k FROM {at(NOW, 'res')} r) t",
    "a26_allocation_extremes": f"SELECT (SELECT size FROM {at(NOW)} a ORDER BY size DESC LIMIT 1) AS most, (SELECT size FROM {at(NOW)} b ORDER BY size LIMIT 1) AS least",
    "f01_f09_size_between": "SELECT alloc_id, size FROM {allocs} WHERE NOT (size < 65536 OR size > 524288)",
    "f02_f08_substring_search": "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%a1%' OR p_brand ILIKE '%brand#1%' OR p_type ILIKE '%steel%'",
    "f04_f05_f06_categories": "SELECT res_id, heap, usage FROM {res} WHERE heap % 2 = 0 AND usage IN (3, 5, 6)",
    "f14_table_updates": "SELECT res_id, pa FROM {maps} EXCEPT ALL SELECT res_id, pa FROM {maps} WHERE unmap OR pa = 0",
    "f17_series_mask": f"SELECT CAST(sum(size) AS BIGINT) AS most FROM {at(NOW)} a WHERE heap < 3 GROUP BY heap ORDER BY 1 DESC LIMIT 1",
    "f20_lookup": "SELECT alloc_id, CAST(80740352 AS BIGINT) AS base, size FROM {allocs} WHERE base = 80740352",
    "o01_resource_order": f"WITH r AS (SELECT * FROM {at(NOW, 'res')} x) SELECT a.res_id, count(*) AS n FROM r a JOIN r b ON b.alloc_id = a.alloc_id AND (b.rsize > a.rsize OR b.rsize = a.rsize AND (CAST(b.usage <> 2 AS INTEGER), b.res_id) <= (CAST(a.usage <> 2 AS INTEGER), a.res_id)) GROUP BY a.res_id",
    "o03_largest_allocations": f"SELECT alloc_id, size FROM (SELECT alloc_id, size, row_number() OVER (ORDER BY size DESC, alloc_id) AS k FROM {at(NOW)} a) t WHERE k <= 50",
    "o04_history_order": "SELECT a.seq, count(*) AS n FROM {toks} a JOIN {toks} b ON b.pid = a.pid AND (b.kind, b.ts, b.seq) <= (a.kind, a.ts, a.seq) GROUP BY a.seq",
    "o07_o08_address_order": "SELECT a.res_id, count(*) FILTER (WHERE (b.off, b.res_id) <= (a.off, a.res_id)) AS by_address, count(*) FILTER (WHERE (-b.rsize, b.res_id) <= (-a.rsize, a.res_id)) AS by_size FROM {res} a JOIN {res} b ON b.alloc_id = a.alloc_id GROUP BY a.res_id",
    "p04_p05_p06_offsets_and_overlap": "SELECT res_id, off AS offset_in_allocation, least(off + rsize, 65536) > greatest(off, 4096) AS overlaps FROM {res}",
    "p19_p21_p22_names": "SELECT res_id, concat('RESOURCE ', res_id) AS name, CASE WHEN coalesce(free_ts, 1000001) < 1000001 THEN 'Orphaned' ELSE ['Local', '-', '-', '-'][heap + 1] END AS label FROM {res}",
    "n01_restamped": "SELECT res_id, name, event_time FROM (SELECT res_id, name, t - 500 AS event_time FROM {names}) n WHERE event_time >= 0",
    "n05_names_in_life": "SELECT res_id, t, name FROM {names} WHERE t - created BETWEEN 0 AND 999",
    "h08_typed_events": "SELECT kind, count(*) AS n, arg_min(ts, ts) AS first_ts, arg_max(ts, ts) AS last_ts, max(size) FILTER (WHERE kind = 12) AS largest FROM {toks} GROUP BY kind",
}
ORACLE_SQL.update({name: proxies.oracle(text) for name, text in _IN_OTHER_WORDS.items()})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["w01_w05_w06_live_bytes"](spark, sf_dir)
