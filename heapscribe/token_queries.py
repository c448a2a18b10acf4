"""Registered queries over replayed tokens: naming, marks, residency and histories, each with SQL that tells it in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import enums, scalars, sheets
from .operators import aliasing, history, intervals, naming, replay, residency
from .registry import _FOLD, _SHARED, _STATES, _TOPS, frame, tape


def reel(view) -> DataFrame:
    return view("reel").withColumn("pref", F.array("heap"))


def _on_reel(text: str) -> str:
    return text.replace("{tape}", "{reel}")


#: Allocations as the replay has them, and the one that each lookup finds.
_HELD = _on_reel(f"{_SHARED}, {_FOLD}")
_FOUND = """found AS (SELECT b.trace_id, b.seq, max(a.va) AS base, arg_max(a.seq, a.va) AS alloc_seq FROM {reel} b JOIN held a ON NOT a.held AND a.trace_id = b.trace_id AND a.va <= b.va AND b.va < a.va + a.size AND a.seq <= b.seq AND (a.ends IS NULL OR b.seq < a.ends)
  WHERE b.kind IN (6, 7, 10) AND NOT (b.is_system AND b.va = 0) GROUP BY b.trace_id, b.seq)"""
#: Tokens of resources in their lives: the create before them, and no destroy between.
_LIVES = """lives AS (SELECT t.*, c.seq AS create_seq, c.ts AS created, c.resource_type AS created_type FROM {reel} t ASOF JOIN (SELECT trace_id, driver_id, seq, ts, resource_type FROM {reel} WHERE kind = 13) c ON c.trace_id = t.trace_id AND c.driver_id = t.driver_id AND t.seq >= c.seq
  WHERE t.kind IN (1, 7, 13, 15) AND NOT EXISTS (SELECT 1 FROM {reel} x WHERE x.kind = 15 AND x.trace_id = t.trace_id AND x.driver_id = t.driver_id AND x.seq > c.seq AND x.seq < t.seq))"""
_NAMING = """made AS (SELECT trace_id, driver_id, seq, ts, resource_type, ts * 100000000 + seq AS pos FROM {reel} WHERE kind = 13 AND resource_type IN (0, 1, 11)),
links AS (SELECT trace_id, driver_id, correlation_id, ts * 100000000 + seq AS pos FROM {reel} WHERE kind = 4 AND user_kind = 4),
linked AS (SELECT l.trace_id, l.correlation_id, l.pos, m.driver_id, m.seq, m.ts, m.resource_type FROM links l ASOF LEFT JOIN made m ON m.trace_id = l.trace_id AND m.driver_id = l.driver_id AND l.pos >= m.pos),
own AS (SELECT trace_id, driver_id AS id, pos, driver_id, seq, ts, resource_type FROM made UNION ALL SELECT trace_id, driver_id, pos, NULL, NULL, NULL, NULL FROM links),
asked AS (SELECT trace_id, driver_id AS id, seq AS token, ts - delay AS t, (ts - delay) * 100000000 + seq AS pos, user_kind, name, implicit FROM {reel} WHERE kind = 4 AND ts >= delay AND (user_kind IN (0, 6) AND name IS NOT NULL OR user_kind IN (5, 7))),
seen AS (SELECT a.*, a.trace_id IN (SELECT trace_id FROM links) AS several, o.driver_id AS d_driver, o.seq AS d_seq, o.ts AS d_ts, o.resource_type AS d_type, v.driver_id AS v_driver, v.seq AS v_seq, v.ts AS v_ts
  FROM asked a ASOF LEFT JOIN own o ON o.trace_id = a.trace_id AND o.id = a.id AND a.pos >= o.pos ASOF LEFT JOIN linked v ON v.trace_id = a.trace_id AND v.correlation_id = a.id AND a.pos >= v.pos),
resolved AS (SELECT trace_id, id, token, t, pos, user_kind, name, implicit, several AND coalesce(d_type = 1, false) AS direct, CASE WHEN NOT several OR coalesce(d_type = 1, false) THEN d_driver ELSE v_driver END AS driver_id,
  CASE WHEN NOT several OR coalesce(d_type = 1, false) THEN d_seq ELSE v_seq END AS create_seq, CASE WHEN NOT several OR coalesce(d_type = 1, false) THEN d_ts ELSE v_ts END AS create_ts FROM seen),
named AS (SELECT trace_id, driver_id, create_seq, create_ts, t AS event_time, arg_min(name, token) AS name FROM (
  SELECT n.trace_id, n.t, n.token, n.name, coalesce(n.driver_id, f.driver_id) AS driver_id, coalesce(n.create_seq, f.create_seq) AS create_seq, coalesce(n.create_ts, f.create_ts) AS create_ts
  FROM resolved n ASOF LEFT JOIN (SELECT * FROM resolved WHERE name IS NOT NULL AND NOT direct AND create_seq IS NOT NULL) f ON f.trace_id = n.trace_id AND f.id = n.id AND n.pos <= f.pos WHERE n.name IS NOT NULL) o
  WHERE create_ts <= t GROUP BY ALL)"""
_IMPLICIT = """at_base AS (SELECT l.trace_id, f.alloc_seq, l.driver_id, l.create_seq, l.created_type, l.seq FROM lives l JOIN found f ON f.trace_id = l.trace_id AND f.seq = l.seq WHERE l.kind = 7 AND l.va = f.base AND l.created_type IN (0, 1, 11)),
pairs AS (SELECT h.trace_id, h.driver_id AS h_driver, h.create_seq AS h_seq, p.driver_id AS p_driver, p.create_seq AS p_seq FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, alloc_seq ORDER BY seq) AS k FROM at_base WHERE created_type = 11) h
  JOIN (SELECT *, row_number() OVER (PARTITION BY trace_id, alloc_seq ORDER BY seq) AS k FROM at_base WHERE created_type < 11) p ON p.trace_id = h.trace_id AND p.alloc_seq = h.alloc_seq AND p.k = 1 WHERE h.k = 1),
marks AS (SELECT DISTINCT trace_id, driver_id, create_seq, coalesce(implicit, 0) = 1 AS of_heap FROM resolved WHERE user_kind IN (5, 7) AND create_seq IS NOT NULL),
heaps AS (SELECT DISTINCT p.trace_id, p.h_driver AS driver_id, p.h_seq AS create_seq FROM pairs p JOIN marks m ON m.of_heap AND m.trace_id = p.trace_id AND m.driver_id = p.p_driver AND m.create_seq = p.p_seq),
plain AS (SELECT DISTINCT trace_id, driver_id, create_seq FROM marks WHERE NOT of_heap),
implicit AS (SELECT *, 'heap' AS kind FROM heaps UNION ALL SELECT *, 'resource' FROM plain m WHERE NOT EXISTS (SELECT 1 FROM heaps h WHERE h.trace_id = m.trace_id AND h.driver_id = m.driver_id AND h.create_seq = m.create_seq)
  AND NOT EXISTS (SELECT 1 FROM pairs p JOIN (SELECT * FROM heaps UNION SELECT * FROM plain) x ON x.trace_id = p.trace_id AND x.driver_id = p.h_driver AND x.create_seq = p.h_seq WHERE p.trace_id = m.trace_id AND p.p_driver = m.driver_id AND p.p_seq = m.create_seq))"""
_EVENT = """CASE kind WHEN 13 THEN 'create' WHEN 7 THEN 'bind' WHEN 15 THEN 'destroy' WHEN 12 THEN 'allocate' WHEN 11 THEN 'free' WHEN 6 THEN CASE WHEN op = 0 THEN 'make resident' ELSE 'evict' END
  WHEN 10 THEN CASE WHEN unmap THEN 'cpu unmap' ELSE 'cpu map' END ELSE CASE WHEN unmap THEN 'unmap' WHEN pa = 0 THEN 'map to host' ELSE 'map to local' END END"""
#: Addresses that are asked for.
_ASKED = "SELECT DISTINCT 't' || CAST(c_custkey % 3 AS STRING) AS trace_id, (c_custkey // 3 + 1) * 16777216 + c_custkey % 8 * 65536 + c_custkey % 11 * 4096 AS address FROM {customer}"
_BLOCKS = f"asked_at AS ({_ASKED}), blocks AS (SELECT DISTINCT q.trace_id, q.address, t.va AS base, t.va + t.size AS hi FROM asked_at q JOIN both_tokens t ON t.kind = 12 AND t.trace_id = q.trace_id AND t.va <= q.address AND q.address < t.va + t.size)"
_BOTH = "both_tokens AS (SELECT trace_id, seq, ts, kind, va, size FROM {reel})"


@frame("j12_n02_n03_name_chain", _on_reel(f"WITH {_NAMING} SELECT trace_id, driver_id, create_seq, event_time, name FROM named"))
def name_chain(view):
    return naming.names(reel(view)).select("trace_id", "driver_id", "create_seq", "event_time", "name")


@frame(
    "j13_replayed_name_as_of",
    _on_reel(f"WITH {_NAMING} SELECT trace_id, driver_id, create_seq, coalesce(arg_max(name, event_time) FILTER (WHERE event_time <= 600000), arg_min(name, event_time)) AS name FROM named GROUP BY ALL"),
)
def name_as_of(view):
    return naming.names_at(naming.names(reel(view)), F.lit(600_000))


def _state(view) -> tuple[DataFrame, DataFrame]:
    tokens = reel(view)
    return tokens, replay.swept(replay.with_shared(tokens))


@frame("n04_j11_implicit", f"WITH RECURSIVE {_HELD}, {_FOUND}, {_LIVES}, {_NAMING}, {_IMPLICIT} SELECT trace_id, driver_id, create_seq, kind FROM implicit")
def implicit(view):
    return naming.implicit(*_state(view))


@frame(
    "n06_f12_visible_tokens",
    f"WITH RECURSIVE {_HELD}, {_FOUND}, {_LIVES}, {_NAMING}, {_IMPLICIT} SELECT l.trace_id, l.seq, l.kind FROM lives l WHERE NOT EXISTS (SELECT 1 FROM implicit i WHERE i.trace_id = l.trace_id AND i.driver_id = l.driver_id AND i.create_seq = l.create_seq)",
)
def visible_tokens(view):
    """Tokens of resources without those of implicit ones: all later queries see the same."""
    tokens, state = _state(view)
    return naming.visible(replay.lives(tokens), naming.implicit(tokens, state)).select("trace_id", "seq", "kind")


@frame(
    "w15_r10_r11_residency",
    f"""WITH RECURSIVE {_HELD}, {_FOUND}, touched AS (SELECT t.trace_id, f.alloc_seq, t.seq, t.ts, CASE WHEN t.kind = 6 THEN CASE WHEN t.op = 0 THEN 'add' ELSE 'remove' END WHEN t.unmap THEN 'unmap' ELSE 'map' END AS what FROM {{reel}} t JOIN found f ON f.trace_id = t.trace_id AND f.seq = t.seq WHERE t.kind IN (6, 10))
SELECT trace_id, alloc_seq, count(*) FILTER (WHERE what = 'add') AS adds, count(*) FILTER (WHERE what = 'remove') AS removes, count(*) FILTER (WHERE what = 'map') - count(*) FILTER (WHERE what = 'unmap') AS maps,
coalesce(arg_max(what, seq) FILTER (WHERE what IN ('add', 'remove')) = 'add', false) AS resident, coalesce(arg_max(what, seq) FILTER (WHERE what IN ('map', 'unmap')) = 'map', false) AS mapped,
bool_or(what = 'add') AS was_resident, bool_or(what = 'remove') AS was_evicted, bool_or(what = 'map') AS was_mapped, max(ts) FILTER (WHERE what IN ('add', 'remove')) AS last_residency, max(ts) FILTER (WHERE what = 'map') AS last_map, max(ts) FILTER (WHERE what = 'unmap') AS last_unmap
FROM touched GROUP BY trace_id, alloc_seq""",
)
def residency_state(view):
    return residency.residency(residency.touches(*_state(view)))


@frame(
    "w03_replayed_aliased_bytes",
    f"""WITH RECURSIVE {_SHARED}, {_FOLD}, {_STATES}, x AS (SELECT s.trace_id, s.address AS lo, s.address + s.size AS hi, s.ts AS a, CASE WHEN h.free_ts IS NULL OR s.valid_to <= h.free_ts THEN s.valid_to ELSE h.free_ts END AS b, h.seq AS alloc_id,
  CASE s.resource_type WHEN 1 THEN CASE WHEN s.flags & 4096 <> 0 THEN 4 ELSE 3 END WHEN 0 THEN 5 WHEN 15 THEN 9 ELSE 8 END AS usage
  FROM states s JOIN {{tape}} k ON k.trace_id = s.trace_id AND k.driver_id = s.driver_id AND k.kind = 7 AND k.ts = s.bind_ts AND k.va = s.address JOIN found f ON f.trace_id = k.trace_id AND f.seq = k.seq JOIN held h ON NOT h.held AND h.trace_id = k.trace_id AND h.va = f.base AND h.seq <= k.seq AND (h.ends IS NULL OR k.seq < h.ends)
  WHERE s.live AND s.base IS NOT NULL AND s.resource_type <> 11),
q AS (SELECT DISTINCT alloc_id, trace_id, lo, hi, a, b, usage FROM x WHERE b IS NULL OR b > a),
g0 AS (SELECT trace_id, alloc_id, p AS s, lead(p) OVER (PARTITION BY trace_id, alloc_id ORDER BY p) AS e FROM (SELECT trace_id, alloc_id, lo AS p FROM q UNION SELECT trace_id, alloc_id, hi FROM q) u),
c AS (SELECT g0.trace_id || ' ' || CAST(g0.alloc_id AS VARCHAR) AS alloc_id, g0.s, g0.e - g0.s AS width, q.usage, q.a, q.b FROM g0 JOIN q ON q.trace_id = g0.trace_id AND q.alloc_id = g0.alloc_id AND q.lo <= g0.s AND q.hi >= g0.e WHERE g0.e IS NOT NULL), {_TOPS}""",
)
def replayed_aliased_bytes(view):
    """Aliased bytes by usage and bucket as resources are bound, updated, bound anew and destroyed, or their allocation goes."""
    tokens = tape(view)
    state = replay.swept(replay.with_shared(tokens))
    ends = state.where("kind = 12 AND taken").select("trace_id", F.col("seq").alias("alloc_seq"), F.col("end_ts").alias("_end"))
    bound = replay.spans_of(tokens, state).where("base IS NOT NULL AND usage <> 2").join(ends, ["trace_id", "alloc_seq"])
    bound = bound.select("trace_id", "alloc_seq", "usage", "valid_from", F.least("valid_to", "_end").alias("until"), F.col("address").alias("lo"), F.expr("address + size").alias("hi"))
    return intervals.step_timeline(aliasing.changes(bound, ["trace_id", "alloc_seq"], "lo", "hi", "valid_from", "until"), "usage", scalars.BUCKET)


@frame(
    "h03_allocation_history",
    _on_reel(f"""WITH RECURSIVE {_HELD}, {_FOUND}, {_LIVES}, {_BOTH}, {_BLOCKS}, bases AS (SELECT DISTINCT trace_id, address, base FROM blocks),
touching AS (SELECT DISTINCT q.trace_id, q.address, l.driver_id, l.create_seq FROM asked_at q JOIN lives l ON l.kind = 7 AND l.trace_id = q.trace_id AND l.va <= q.address AND q.address < l.va + l.size),
hist AS (SELECT l.trace_id, t.address, l.seq, l.ts, {_EVENT.replace("kind", "l.kind", 1).replace("op =", "l.op =").replace("unmap", "l.unmap").replace("'cpu l.unmap'", "'cpu unmap'").replace("'l.unmap'", "'unmap'").replace("pa =", "l.pa =")} AS event, l.driver_id, l.va, f.base, f.alloc_seq
  FROM lives l JOIN touching t ON t.trace_id = l.trace_id AND t.driver_id = l.driver_id AND t.create_seq = l.create_seq LEFT JOIN found f ON f.trace_id = l.trace_id AND f.seq = l.seq
  WHERE l.kind IN (7, 13, 15) AND (l.kind <> 7 OR f.base IS NOT NULL AND (l.created_type = 11 OR EXISTS (SELECT 1 FROM bases b WHERE b.trace_id = t.trace_id AND b.address = t.address AND b.base = f.base)))
  UNION ALL SELECT r.trace_id, b.address, r.seq, r.ts, CASE r.kind WHEN 12 THEN 'allocate' ELSE 'free' END, NULL, r.va, NULL, NULL FROM {{reel}} r JOIN bases b ON b.trace_id = r.trace_id AND b.base = r.va WHERE r.kind IN (11, 12)
  UNION ALL SELECT r.trace_id, b.address, r.seq, r.ts, r.event, NULL, r.va, CASE WHEN o.base IS NOT NULL THEN f.base END, CASE WHEN o.base IS NOT NULL THEN f.alloc_seq END FROM (SELECT *, {_EVENT} AS event FROM {{reel}} WHERE kind IN (3, 6, 10)) r
    JOIN (SELECT DISTINCT r.trace_id, r.seq, b.address FROM {{reel}} r JOIN blocks b ON b.trace_id = r.trace_id AND b.base <= r.va AND r.va < b.hi WHERE r.kind IN (3, 6, 10)) b ON b.trace_id = r.trace_id AND b.seq = r.seq
    LEFT JOIN found f ON f.trace_id = r.trace_id AND f.seq = r.seq LEFT JOIN bases o ON o.trace_id = r.trace_id AND o.address = b.address AND o.base = f.base)
SELECT trace_id, address, seq, ts, event, driver_id, va, base, CASE WHEN event IN ('make resident', 'evict') AND alloc_seq IS NOT NULL THEN coalesce((SELECT string_agg(CAST(b.driver_id AS VARCHAR), ',' ORDER BY b.seq) FROM hist b WHERE b.event = 'bind' AND b.trace_id = e.trace_id AND b.address = e.address AND b.alloc_seq = e.alloc_seq AND b.seq < e.seq), '') END AS bound FROM hist e"""),
)
def allocation_history(view):
    tokens, state = _state(view)
    found = history.full(tokens, state, view(_ASKED))
    return found.select("trace_id", "address", "seq", "ts", "event", "driver_id", "va", "base", F.array_join(F.transform("bound", lambda x: x.cast("string")), ",").alias("bound"))


@frame(
    "h04_basic_history",
    _on_reel(f"""WITH {_BOTH}, {_BLOCKS} SELECT b.trace_id, b.address, t.seq, t.ts, 'allocate' AS event, t.va FROM blocks b JOIN both_tokens t ON t.kind = 12 AND t.trace_id = b.trace_id AND t.va = b.base AND t.va + t.size = b.hi
UNION ALL SELECT b.trace_id, b.address, t.seq, t.ts, 'free', t.va FROM (SELECT DISTINCT trace_id, address, base FROM blocks) b JOIN both_tokens t ON t.kind = 11 AND t.trace_id = b.trace_id AND t.va = b.base"""),
)
def basic_history(view):
    return history.basic(reel(view), view(_ASKED))


@frame(
    "h05_creates_at_address",
    _on_reel(f"""WITH {_LIVES}, {_BOTH}, {_BLOCKS} SELECT DISTINCT q.trace_id, q.address, l.driver_id, l.create_seq, l.created AS ts FROM blocks q JOIN lives l ON l.kind = 7 AND l.trace_id = q.trace_id AND l.va >= q.base AND l.va < q.hi"""),
)
def creates_at_address(view):
    """Creates of the resources bound within any allocation that was ever made over an address."""
    tokens = reel(view)
    made = replay.lives(tokens).where("kind = 13").select("trace_id", "driver_id", "create_seq", "ts")
    return history.touching(tokens, view(_ASKED), everything=True).join(made, ["trace_id", "driver_id", "create_seq"])


@frame(
    "h01_h02_resource_history",
    _on_reel(f"""WITH RECURSIVE {_HELD}, {_FOUND}, {_LIVES}, {_NAMING}, key AS (SELECT DISTINCT trace_id, driver_id, create_seq FROM lives WHERE kind = 13),
bound AS (SELECT l.trace_id, l.driver_id, l.create_seq, l.va AS lo, l.va + l.size AS hi, f.alloc_seq FROM lives l JOIN found f ON f.trace_id = l.trace_id AND f.seq = l.seq WHERE l.kind = 7),
held_by AS (SELECT DISTINCT trace_id, driver_id, create_seq, alloc_seq FROM bound),
gone AS (SELECT k.*, (SELECT min(x.ts) FROM {{reel}} x WHERE x.trace_id = k.trace_id AND x.driver_id = k.driver_id AND x.kind IN (13, 15) AND x.seq > k.create_seq) AS until FROM key k)
SELECT trace_id, driver_id, create_seq, seq, ts, CASE kind WHEN 13 THEN 'create' WHEN 7 THEN 'bind' ELSE 'destroy' END AS event, va FROM lives WHERE kind IN (7, 13, 15)
UNION ALL SELECT b.trace_id, b.driver_id, b.create_seq, h.seq, h.ts, 'allocate', h.va FROM held_by b JOIN held h ON NOT h.held AND h.trace_id = b.trace_id AND h.seq = b.alloc_seq
UNION ALL SELECT b.trace_id, b.driver_id, b.create_seq, h.ends, h.free_ts, 'free', h.va FROM held_by b JOIN held h ON NOT h.held AND h.trace_id = b.trace_id AND h.seq = b.alloc_seq WHERE h.ends IS NOT NULL
UNION ALL SELECT b.trace_id, b.driver_id, b.create_seq, r.seq, r.ts, r.event, r.va FROM held_by b JOIN found f ON f.trace_id = b.trace_id AND f.alloc_seq = b.alloc_seq JOIN (SELECT *, {_EVENT} AS event FROM {{reel}} WHERE kind IN (6, 10)) r ON r.trace_id = f.trace_id AND r.seq = f.seq
UNION ALL SELECT trace_id, driver_id, create_seq, min(seq), ts, event, va FROM (SELECT DISTINCT b.trace_id, b.driver_id, b.create_seq, r.seq, r.ts, r.event, r.va FROM bound b JOIN (SELECT *, {_EVENT} AS event FROM {{reel}} WHERE kind = 3) r ON r.trace_id = b.trace_id AND r.va < b.hi AND b.lo < r.va + r.size) u GROUP BY trace_id, driver_id, create_seq, ts, event, va
UNION ALL SELECT n.trace_id, n.driver_id, n.create_seq, NULL, n.event_time, 'name', NULL FROM named n JOIN gone g ON g.trace_id = n.trace_id AND g.driver_id = n.driver_id AND g.create_seq = n.create_seq WHERE n.event_time >= n.create_ts AND (g.until IS NULL OR n.event_time < g.until)"""),
)
def resource_history(view):
    tokens, state = _state(view)
    every = replay.lives(tokens).where("kind = 13").select("trace_id", "driver_id", "create_seq")
    return history.of_resources(tokens, state, every, naming.names(tokens))


@frame(
    "h06_h09_all_resources",
    _on_reel(f"""WITH RECURSIVE {_HELD}, {_FOUND}, {_LIVES}, {_NAMING}, {_IMPLICIT}, theirs AS (SELECT l.* FROM lives l WHERE l.kind IN (7, 13, 15) AND NOT EXISTS (SELECT 1 FROM implicit i WHERE i.trace_id = l.trace_id AND i.driver_id = l.driver_id AND i.create_seq = l.create_seq))
SELECT trace_id, seq, ts, CASE kind WHEN 13 THEN 'create' WHEN 7 THEN 'bind' ELSE 'destroy' END AS event, driver_id, create_seq, va, NULL AS bound FROM theirs
UNION ALL SELECT r.trace_id, r.seq, r.ts, CASE WHEN r.op = 0 THEN 'make resident' ELSE 'evict' END, NULL, NULL, r.va, coalesce((SELECT string_agg(d, ',' ORDER BY k) FROM (SELECT DISTINCT CAST(o.driver_id AS VARCHAR) AS d, o.driver_id AS k FROM theirs o JOIN found g ON g.trace_id = o.trace_id AND g.seq = o.seq
  WHERE o.kind = 7 AND o.trace_id = r.trace_id AND g.alloc_seq = f.alloc_seq AND o.seq < r.seq AND NOT EXISTS (SELECT 1 FROM theirs x WHERE x.kind = 15 AND x.trace_id = o.trace_id AND x.driver_id = o.driver_id AND x.create_seq = o.create_seq AND x.seq < r.seq)) b), '')
FROM {{reel}} r JOIN found f ON f.trace_id = r.trace_id AND f.seq = r.seq WHERE r.kind = 6"""),
)
def all_resources(view):
    tokens, state = _state(view)
    found = history.every(tokens, state, naming.implicit(tokens, state))
    return found.withColumn("bound", F.array_join(F.transform("bound", lambda x: x.cast("string")), ","))


@frame("h07_bind_enrichment", _on_reel(f"WITH RECURSIVE {_HELD}, {_FOUND} SELECT f.trace_id, f.seq, b.driver_id, b.va, f.base, CASE WHEN h.made = 1 THEN 0 ELSE h.heap END AS preferred FROM found f JOIN {{reel}} b ON b.trace_id = f.trace_id AND b.seq = f.seq AND b.kind = 7 JOIN held h ON NOT h.held AND h.trace_id = f.trace_id AND h.seq = f.alloc_seq"))
def bind_enrichment(view):
    return history.enriched_binds(*_state(view)).select("trace_id", "seq", "driver_id", "va", "base", F.element_at("pref", 1).alias("preferred"))


# --- property sheets -------------------------------------------------------------------------

#: Creates of every resource type, with payloads of the format's length whose bits are those of checksums of their numbers.
_CREATES = "SELECT seq, seq % 18 AS resource_type, md5('a' || CAST(seq AS STRING)) || md5('b' || CAST(seq AS STRING)) || md5('c' || CAST(seq AS STRING)) AS bytes FROM {toks}"


def _sheet_sql() -> str:
    def memory(v: str) -> str:
        units = ["bytes", "KiB", "MiB", "GiB", "TiB", "PiB"]
        cases = " ".join(f"WHEN {v} < {1024 ** (k + 1)} THEN format('{{:,.2f}}', {v} / {float(1024**k)}) || ' {u}'" for k, u in enumerate(units) if k)
        return f"CASE WHEN {v} < 1024 THEN format('{{:,}}', {v}) || ' bytes' {cases} END"

    def number(high: int, low: int) -> str:
        high = min(high, low + sheets.WIDEST - 1)
        parts = " + ".join(f"(CAST('0x' || substr(bytes, {2 * at + 1}, 2) AS BIGINT) << {8 * k})" for k, at in enumerate(range(low // 8, high // 8 + 1)))
        return f"((({parts}) >> {low % 8}) & {(1 << high - low + 1) - 1})"

    def shown(high: int, low: int, how: str) -> str:
        v = number(high, low)
        if how == "hash":
            word = lambda first: " || ".join(f"substr(bytes, {2 * (first + k) + 1}, 2)" for k in range(7, -1, -1))
            return f"CASE WHEN {word(1)} <> '{'0' * 16}' THEN {word(1)} || {word(9)} WHEN {word(9)} <> '{'0' * 16}' THEN {word(9)} ELSE 'N/A' END"
        if how in sheets.FLAGS:
            names = getattr(enums, how)
            parts = ", ".join(f"CASE WHEN ({v} >> {k}) & 1 = 1 THEN '{n}' END" for k, n in enumerate(names))
            return f"CASE WHEN {v} = 0 THEN 'None' ELSE concat_ws(' | ', {parts}) || ' (' || CAST({v} AS VARCHAR) || ')' END"
        if how.isupper():
            names = getattr(enums, how)
            return f"coalesce({list(names)}[{v} + 1], 'Unknown')"
        if how == "swizzle":
            return " || ".join(f"coalesce({list(enums.SWIZZLES)}[(({v} >> {3 * k}) & 7) + 1], 'Unknown')" for k in range(4))
        return {"number": f"format('{{:,}}', {v})", "next": f"format('{{:,}}', {v} + 1)", "power": f"format('{{:,}}', CAST(1 AS BIGINT) << {v})", "flag": f"CASE WHEN {v} = 1 THEN 'True' ELSE 'False' END", "bytes": memory(v), "chunks": memory(f"({v} * 4096)"), "pages": memory(f"(CAST(1 AS BIGINT) << {v})")}[how]

    return " UNION ALL ".join(f"SELECT seq, {n} AS place, '{p}' AS property, {shown(high, low, how)} AS value FROM creates WHERE resource_type = {k}" for k, rows in sheets.SHEETS.items() for n, (p, high, low, how) in enumerate(rows))


@frame("p29_property_sheets", f"WITH creates AS ({_CREATES}) {_sheet_sql()}")
def property_sheets(view):
    """The sheet of each create, by its type: 26 rows of an image, 3 of a buffer, and so on."""
    return sheets.properties(view(_CREATES).withColumn("payload", F.unhex("bytes")), ["seq"])


@frame(
    "p22_p23_p39_resource_labels",
    f"""WITH RECURSIVE {_SHARED}, {_FOLD}, {_STATES}, s AS (SELECT x.*, h.seq AS alloc_id, CASE WHEN h.made = 1 THEN 0 ELSE h.heap END AS heap, h.ts AS alloc_ts, h.free_ts, CASE x.resource_type WHEN 1 THEN CASE WHEN x.flags & 4096 <> 0 THEN 4 ELSE 3 END WHEN 0 THEN 5 WHEN 11 THEN 2 WHEN 15 THEN 9 ELSE 8 END AS usage
  FROM (SELECT * FROM states WHERE live AND ts <= 600000 AND (valid_to IS NULL OR valid_to > 600000)) x LEFT JOIN {{tape}} k ON x.base IS NOT NULL AND k.trace_id = x.trace_id AND k.driver_id = x.driver_id AND k.kind = 7 AND k.ts = x.bind_ts AND k.va = x.address AND k.size = x.size
  LEFT JOIN held h ON NOT h.held AND h.trace_id = x.trace_id AND h.va = x.base AND h.seq <= k.seq AND (h.ends IS NULL OR k.seq < h.ends)),
w AS (SELECT *, (max(create_ts) OVER () - min(create_ts) OVER ()) // 10 AS step, min(create_ts) OVER () AS first FROM s)
SELECT DISTINCT trace_id, driver_id, {list(enums.USAGES)}[usage + 1] AS usage, CASE WHEN base IS NULL THEN '-' WHEN free_ts <= 600000 THEN 'Orphaned' ELSE ['Local', 'Invisible', 'Host', 'Unspecified'][heap + 1] END AS preferred_heap,
CASE WHEN base IS NULL OR free_ts <= 600000 THEN 'Unknown' ELSE ['Local', 'Invisible', 'Host', 'Unspecified'][heap + 1] END AS actual_heap, CAST(CASE WHEN step = 0 THEN -1 ELSE least(greatest((create_ts - first) // nullif(step, 0), 0), 9) END AS INTEGER) AS create_age FROM w""",
)
def resource_labels(view):
    """What resources are coloured by at one time: usage, the heap that their allocation prefers (freed: orphaned; none: -), the heap that it is in, and the age of their create."""
    tokens, t = tape(view), 600_000
    state = replay.swept(replay.with_shared(tokens))
    live = replay.state_at(replay.spans_of(tokens, state), t)
    allocs = state.where("kind = 12 AND taken").select("trace_id", F.col("seq").alias("alloc_seq"), F.element_at("pref", 1).alias("heap"), "end_ts")
    rows = live.join(allocs, ["trace_id", "alloc_seq"], "left")
    ends = F.broadcast(rows.agg(F.min("create_ts").alias("_lo"), F.max("create_ts").alias("_hi")))  # one row
    gone, heap = F.coalesce(F.col("end_ts") <= t, F.lit(False)), enums.named(F.col("heap"), enums.HEAPS)
    preferred = F.when(F.col("base").isNull(), "-").when(gone, "Orphaned").otherwise(heap)
    actual = F.when(F.col("base").isNull() | gone, "Unknown").otherwise(heap)
    age = scalars.age_bucket(F.col("create_ts"), F.col("_lo"), F.col("_hi"))
    return rows.crossJoin(ends).select("trace_id", "driver_id", enums.named(F.col("usage"), enums.USAGES).alias("usage"), preferred.alias("preferred_heap"), actual.alias("actual_heap"), age.alias("create_age"))


#: Running counts as a profile makes them, token by token: allocates and frees, creates and destroys; creates of shareable images count as allocations too.
_PROFILE_STEPS = """SELECT trace_id, seq, ts, CASE WHEN kind = 12 OR kind = 13 AND resource_type = 0 AND (create_flags & 4) <> 0 THEN 1 WHEN kind = 11 THEN -1 ELSE 0 END AS a, CASE kind WHEN 13 THEN 1 WHEN 15 THEN -1 ELSE 0 END AS r FROM {tape}"""


@frame(
    "a01_token_profile",
    f"""SELECT trace_id, CAST(sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS BIGINT) AS allocations, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS resources, CAST(greatest(max(live_a), 0) AS BIGINT) AS most_allocations, CAST(greatest(max(live_r), 0) AS BIGINT) AS most_resources, max(ts) AS last_ts
FROM (SELECT *, sum(a) OVER (PARTITION BY trace_id ORDER BY seq) AS live_a, sum(r) OVER (PARTITION BY trace_id ORDER BY seq) AS live_r FROM ({_PROFILE_STEPS}) s) t GROUP BY trace_id""",
)
def token_profile(view):
    """Counts of a trace, and the most allocations and resources at one time."""
    steps = intervals.running(view(_PROFILE_STEPS), ["trace_id"], ["seq"], F.expr("seq div 100000"), {"live_a": ("sum", F.col("a")), "live_r": ("sum", F.col("r"))})
    most = lambda c: F.greatest(F.max(c), F.lit(0)).alias("most_" + {"live_a": "allocations", "live_r": "resources"}[c])
    return steps.groupBy("trace_id").agg(F.count_if(F.col("a") > 0).alias("allocations"), F.count_if(F.col("r") > 0).alias("resources"), most("live_a"), most("live_r"), F.max("ts").alias("last_ts"))
