"""Multi-party perspective rotation of dialogues, in DataFrame functions.

For every participant of a conversation the dialogue is rendered once with that speaker
as the assistant: the speaker's turns become `assistant` messages, the others' become
`user` messages that carry their speaker's name, and turns of the role `system` (which
is no participant) stay system messages. The mask lists the character ranges (code
points, end exclusive) of the speaker's own contents with their closing marks: what a
model would be trained on.

A dialogue is rendered in parts of `part_turns` turns (the last may have fewer), each a row
with its number and the offset of its text within the whole rendering, so a conversation of
any length is spread over tasks: joining the texts of a conversation and speaker in the order
of `part` gives the whole rendering, and adding `start` to a mask's ends its whole mask. With
`part_turns` null a rendering is one row, whatever its length. Offsets are sums of lengths;
texts move once, to be rendered last. Turns are ordered by turn, then role, then text.

Null texts are empty messages; null roles are a participant named "unknown"; a null
conv_id is a conversation of its own; repeated rows are turns of their own. A
conversation of system turns only has no participants and no rows. Other columns than
these four are not read, whatever their names; no rows give no rows; one text of any
length is one message. Strings in a text that look like the template's marks get a
backslash inside, so contents can't forge turns.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, prefix_sums

#: Fixed strings of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART_TURNS = 256


def rotate(turns: DataFrame, part_turns: int | None = PART_TURNS, system: str = "system") -> DataFrame:
    """conv_id, speaker, part, first_turn (number of the part's first), n_turns, n_own, start, text, mask (array of s, e within text) from rows (conv_id, turn, role, text)."""
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|"))
    role = F.coalesce(F.replace(F.regexp_replace("role", r"[\r\n]+", " "), F.lit("<|"), F.lit("<\\|")), F.lit("unknown"))
    clean = turns.select("conv_id", "turn", role.alias("role"), safe.alias("body"), F.lit(1).cast("long").alias("one"))
    numbered = prefix_sums(clean, ["turn", "role", "body"], "one", "number", by="conv_id").withColumn("part", F.floor((F.col("number") - 1) / part_turns).cast("int") if part_turns else F.lit(0))
    speakers = clean.where(F.col("role") != system).select("conv_id", F.col("role").alias("speaker")).distinct()
    same = lambda a, b, *names: reduce(and_, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])
    # Numbers only: where each part of each rendering starts. A turn of the speaker's differs from others' views of it by its head.
    head = F.when(F.col("role") == system, F.lit(f"{OPEN}{system}\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), "role", F.lit("\n")))
    sizes = numbered.select("conv_id", "part", "role", (F.char_length(head) + F.char_length("body") + len(CLOSE) + 1).cast("long").alias("size"))
    sizes = materialize(sizes.groupBy("conv_id", "part", "role").agg(F.sum("size").alias("size"), F.count("*").alias("turns")), "chat_sizes")
    whole = sizes.groupBy("conv_id", "part").agg(F.sum("size").alias("size"))
    views = whole.alias("w").join(speakers.alias("s"), same("w", "s", "conv_id")).select("w.conv_id", "w.part", "w.size", "s.speaker")
    own = sizes.select("conv_id", "part", F.col("role").alias("speaker"), "turns")
    views = views.alias("v").join(own.alias("o"), same("v", "o", "conv_id", "part", "speaker"), "left").select("v.*", F.coalesce("o.turns", F.lit(0)).alias("turns"))
    length = f"size + turns * ({len(OPEN + 'assistant')} - {len(OPEN + 'user name=')} - char_length(speaker))"
    views = views.selectExpr("conv_id", "part", "speaker", f"sum({length}) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS UNBOUNDED PRECEDING) - ({length}) AS start")
    parts = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("number", "role", "body"))).alias("turns"))
    views = parts.alias("p").join(views.alias("v"), same("p", "v", "conv_id", "part")).select("p.*", "v.speaker", "v.start")
    head = f"CASE WHEN t.role = '{system}' THEN '{OPEN}{system}\\n' WHEN t.role = speaker THEN '{OPEN}assistant\\n' ELSE concat('{OPEN}user name=', t.role, '\\n') END"
    pieces = views.withColumn("pieces", F.expr(f"transform(turns, t -> named_struct('own', t.role = speaker, 'head', {head}, 'tail', concat(t.body, '{CLOSE}')))"))
    # Parts are bounded, so the running length over a part's pieces is cheap.
    walk = "aggregate(pieces, named_struct('at', 0, 'mask', cast(array() AS array<struct<s:int,e:int>>)), (a, p) -> named_struct('at', a.at + char_length(p.head) + char_length(p.tail) + 1, 'mask', if(p.own, concat(a.mask, array(named_struct('s', a.at + char_length(p.head), 'e', a.at + char_length(p.head) + char_length(p.tail)))), a.mask)))"
    text = "array_join(transform(pieces, p -> concat(p.head, p.tail, '\n')), '')"
    made = pieces.select("conv_id", "speaker", "part", F.col("turns")[0]["number"].alias("first_turn"), F.size("turns").cast("long").alias("n_turns"), "start", F.expr(text).alias("text"), F.expr(f"{walk}.mask").alias("mask"))
    return made.selectExpr("conv_id", "speaker", "part", "first_turn", "n_turns", "cast(size(mask) AS bigint) AS n_own", "start", "text", "mask")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    made = rotate(load(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat(m["s"].cast("string"), F.lit(":"), m["e"].cast("string"))), ",")
    return made.select("conv_id", "speaker", "part", "first_turn", "n_turns", "n_own", "start", "text", mask.alias("mask"))


ORACLE = r"""
WITH clean AS (
  SELECT conv_id, turn, coalesce(replace(regexp_replace(role, '[\r\n]+', ' ', 'g'), '<|', '<\|'), 'unknown') AS role,
         replace(coalesce(text, ''), '<|', '<\|') AS body
  FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, body) AS number FROM clean),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM clean WHERE role <> 'system'),
pieces AS (
  SELECT n.conv_id, s.speaker, n.number, CAST((n.number - 1) // 256 AS INTEGER) AS part, n.role = s.speaker AS own,
         CASE WHEN n.role = 'system' THEN '<|im_start|>system' WHEN n.role = s.speaker THEN '<|im_start|>assistant'
              ELSE '<|im_start|>user name=' || n.role END || chr(10) AS head,
         n.body || '<|im_end|>' AS tail
  FROM numbered n JOIN speakers s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY number) - length(tail) - 1 AS pos
  FROM pieces),
made AS (
  SELECT conv_id, speaker, part, min(number) AS first_turn, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
         string_agg(head || tail || chr(10), '' ORDER BY number) AS text,
         coalesce(string_agg(CASE WHEN own THEN CAST(CAST(pos AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(tail) AS BIGINT) AS VARCHAR) END, ',' ORDER BY number), '') AS mask
  FROM placed GROUP BY conv_id, speaker, part)
SELECT conv_id, speaker, part, CAST(first_turn AS BIGINT) AS first_turn, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_own AS BIGINT) AS n_own,
       CAST(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part) - length(text) AS BIGINT) AS start, text, mask
FROM made
"""
