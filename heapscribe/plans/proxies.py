"""Deterministic views of the driver's tables that stand in for trace state.

Each view is one SQL text that Spark and an ANSI engine both read (`//` is written
`div` for Spark), so a query and its check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: View: (its SQL, the views or tables that it reads).
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "allocs": (
        """SELECT alloc_id, base, size, heap, owner, alloc_ts, CASE WHEN status = 'F' THEN alloc_ts + life END AS free_ts
FROM (SELECT o_orderkey AS alloc_id, o_orderkey * 1048576 AS base, (1 + o_custkey % 255) * 4096 AS size,
             CAST(o_orderkey % 4 AS INT) AS heap, CAST(o_custkey % 4 AS INT) AS owner, o_orderstatus AS status,
             {days(o_orderdate)} * 1000 + o_orderkey % 1000 AS alloc_ts, (1 + o_custkey % 400) * 1000 AS life
      FROM {orders}) o""",
        ("orders",),
    ),
    "res": (
        """SELECT alloc_id, res_id, off, least(q * 4096, size - off) AS rsize, usage, alloc_ts + n AS bind_ts, alloc_ts, free_ts, heap, base, size
FROM (SELECT a.*, l.l_orderkey * 64 + l.k AS res_id, (l.l_partkey * 4096) % a.size AS off, CAST(l.l_quantity AS BIGINT) AS q,
             CAST(2 + l.l_suppkey % 11 AS INT) AS usage, l.l_linenumber AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k
            FROM {lineitem}) l
      JOIN {allocs} a ON a.alloc_id = l.l_orderkey) r""",
        ("lineitem", "allocs"),
    ),
    "toks": (
        """SELECT event_id AS seq, {seconds(ts)} AS ts, CASE event_type WHEN 'signup' THEN 12 WHEN 'error' THEN 11 WHEN 'click' THEN 10 WHEN 'view' THEN 6 ELSE 7 END AS kind,
       user_id AS pid, CAST((1 + floor(value)) * 4096 AS BIGINT) AS size FROM {events}""",
        ("events",),
    ),
    "maps": (
        """SELECT alloc_id, res_id, heap, off AS lo, off + rsize AS hi, res_id AS seq, bind_ts,
       CASE WHEN usage % 3 = 0 THEN 0 ELSE 4294967296 + (res_id * 4096) % 8589934592 END AS pa, res_id % 7 = 0 AS unmap FROM {res}""",
        ("res",),
    ),
    "names": (
        " UNION ALL ".join(f"SELECT res_id, (alloc_id % 1000) * 10 + {700 * k} AS t, (alloc_id % 1000) * 10 AS created, 'n' || CAST((res_id + {k}) % 97 AS STRING) AS name FROM {{res}}" for k in range(3)),
        ("res",),
    ),
    # Tokens of the trace format (kinds as in sources.trace): allocations and frees in eight places of an arena for each user, and the life of four resources for each.
    "tape": (
        """SELECT 't' || CAST(u % 3 AS STRING) AS trace_id, CAST(0 AS BIGINT) AS stream_index, seq, seq * 16 AS offset, ts, kind, kind = 7 AND v % 7 = 0 AS is_system,
       CASE WHEN kind = 7 AND v % 7 = 0 THEN 0 ELSE (u // 3 + 1) * 16777216 + v % 8 * 65536 + CASE WHEN kind = 7 THEN v % 3 * 4096 ELSE 0 END END AS va,
       CASE WHEN kind = 12 THEN (1 + v % 5) * 49152 ELSE (1 + v % 4) * 4096 END AS size, CAST(v % 4 AS INT) AS heap, v % 4 AS owner, u * 4 + v % 4 AS driver_id,
       CASE v // 4 % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 11 WHEN 3 THEN 15 ELSE 6 END AS resource_type, CASE v % 3 WHEN 0 THEN 4 WHEN 1 THEN 64 ELSE 0 END AS create_flags,
       CASE WHEN v % 2 = 0 THEN 4096 ELSE 192 END AS usage_flags, CASE WHEN v % 4 < 2 THEN 4096 ELSE 0 END AS after, 0 AS user_kind, 'n' || CAST(v % 13 AS STRING) AS name, v % 5 * 1000 AS delay
FROM (SELECT event_id AS seq, {seconds(ts)} AS ts, user_id AS u, CAST(floor(value) AS BIGINT) AS v,
             CASE event_type WHEN 'purchase' THEN 12 WHEN 'error' THEN 11 WHEN 'signup' THEN 13 WHEN 'click' THEN 7 ELSE CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 15 WHEN 1 THEN 1 ELSE 4 END END AS kind
      FROM {events}) e""",
        ("events",),
    ),
    # The tape's tokens with others between them: residency references, CPU maps and page-table updates within the arenas, correlations, names and implicit marks (kinds of user data as in sources.trace; traces t2 have no correlations).
    "reel": (
        """SELECT trace_id, stream_index, seq * 4 AS seq, seq * 64 AS offset, ts, kind, is_system, va, size, heap, owner, driver_id, resource_type, create_flags, usage_flags, after,
       -1 AS user_kind, CAST(NULL AS BIGINT) AS correlation_id, CAST(NULL AS STRING) AS name, CAST(0 AS BIGINT) AS delay, 0 AS implicit, CAST(0 AS BIGINT) AS op, false AS unmap, CAST(NULL AS BIGINT) AS pa FROM {tape} WHERE kind <> 4
UNION ALL SELECT 't' || CAST(u % 3 AS STRING), CAST(0 AS BIGINT), seq * 4 + 1, seq * 64 + 16, ts, CASE v % 3 WHEN 0 THEN 6 WHEN 1 THEN 10 ELSE 3 END, false, (u // 3 + 1) * 16777216 + (v * 5 + u) % 8 * 65536 + v % 6 * 4096,
       (1 + v % 4) * 4096, CAST(NULL AS INT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), -1, CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(0 AS BIGINT), 0, v // 3 % 2, v // 3 % 3 = 1, CASE WHEN v % 5 = 0 THEN 0 ELSE 4294967296 + v * 4096 END FROM {moments} WHERE v % 2 = 0
UNION ALL SELECT 't' || CAST(u % 3 AS STRING), CAST(0 AS BIGINT), seq * 4 + 2, seq * 64 + 32, ts, 4, false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS BIGINT),
       CASE WHEN v % 4 = 0 OR v // 4 % 2 = 0 THEN u * 4 + v // 8 % 4 ELSE 1000000 + u * 4 + v // 16 % 4 END, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT),
       CASE v % 4 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 6 ELSE 7 END, CASE WHEN v % 4 = 0 THEN 1000000 + u * 4 + v // 16 % 4 END, CASE WHEN v % 4 IN (1, 2) THEN 'n' || CAST(v % 13 AS STRING) END, CASE WHEN v % 4 > 1 THEN v % 5 * 1000 ELSE 0 END, CASE WHEN v % 4 = 3 THEN CAST(v // 4 % 3 AS INT) ELSE 0 END,
       CAST(0 AS BIGINT), false, CAST(NULL AS BIGINT) FROM {moments} WHERE v % 4 > 0 OR u % 3 < 2""",
        ("tape", "moments"),
    ),
    "moments": ("SELECT event_id AS seq, {seconds(ts)} AS ts, user_id AS u, CAST(floor(value) AS BIGINT) AS v FROM {events}", ("events",)),
    "segments": ("SELECT 0 AS heap, 4294967296 AS lo, 8589934592 AS hi UNION ALL SELECT 1, 8589934592, 12884901888", ()),
}
TABLES = ("orders", "lineitem", "events", "customer", "part", "supplier")


def spark_sql(text: str) -> str:
    text = re.sub(r"\{days\((\w+)\)\}", r"datediff(CAST(\1 AS DATE), DATE '1995-01-01')", text)
    text = re.sub(r"\{seconds\((\w+)\)\}", r"(unix_micros(CAST(\1 AS TIMESTAMP)) - 1704067200000000) // 1000000", text)
    return text.replace("//", "div")


def ansi_sql(text: str) -> str:
    text = re.sub(r"\{days\((\w+)\)\}", r"date_diff('day', DATE '1995-01-01', CAST(\1 AS DATE))", text)
    text = re.sub(r"\{seconds\((\w+)\)\}", r"(epoch_us(\1) - 1704067200000000) // 1000000", text)
    return re.sub(r"\{(\w+)\}", r"\1", text.replace("AS STRING", "AS VARCHAR"))


def used(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if n in VIEWS or n in TABLES]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return query(spark, sf_dir, VIEWS[name][0])


def query(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Runs a text over views ({name}) and further frames."""
    frames |= {n: view(spark, sf_dir, n) for n in used(text) if n not in frames}
    return spark.sql(spark_sql(text), **frames)


def oracle(text: str, *more: str) -> str:
    """The text for an ANSI engine, with the views that it reads as common table expressions."""
    need: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in need:
            for n in VIEWS[name][1]:
                add(n)
            need.append(name)

    for n in [*used(text), *more]:
        add(n)
    ctes = [f"{n} AS ({ansi_sql(VIEWS[n][0])})" for n in need]
    body = ansi_sql(text).strip()
    if body[:5].upper() == "WITH ":
        recursive, body = ("RECURSIVE ", body[15:]) if body[5:14].upper() == "RECURSIVE" else ("", body[5:])
        return f"WITH {recursive}{', '.join([*ctes, body])}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
