"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

Base spans of four kinds come from regular expressions (with the checks of each kind).
They are the seeds of a pattern-instance graph: a lexical pattern is the word and
punctuation before a mention, alone or with the word after it (of longer words the 24 letters
next to the mention, and nothing that lies more than 40 characters before it; base spans
don't depend on either); an instance is the mentioned string. The graph's other instances are identifier-like strings without base
spans: tokens with enough digits, groups of digits between spaces, dots, dashes and
brackets, and strings around an @, with or without a domain. Rounds of scoring follow: a pattern is worth the mean score of
its distinct instances for a kind, if enough of them are known; an instance gets the
noisy-or of its trusted patterns. Instances that end above `accept` and could be of
the kind by their characters add spans; base spans always stay.

Everything is DataFrame functions: regular expressions mark matches with a private-use
character, the marked text is split at it, and positions (code points) are running
lengths of the pieces, in blocks of BLOCK pieces so that many matches in one text cost
little more than their number. Possessive quantifiers and look-behinds keep the
expressions linear on long runs.

Null texts are empty and have no spans; repeated rows have their own; rows with a null
doc_id are kept. An instance that is as good for two kinds goes to the one listed first. Texts that hold the marking characters are treated as if these were U+FFFD.
Other columns than doc_id and text are not read, whatever their names; texts of any length
are searched whole; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize

KINDS = ("email", "ip", "card", "phone")
MARK, RIGHT = "\ue000", "\ue001"
BLOCK = 256  # even: matches are the odd pieces
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Same matches as the contract's expressions; each leaves out, where it starts or ends, only what its check would drop.
EXPRESSIONS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = "[A-Za-z0-9@._%+#/:-]"
#: Identifier-like: a run of such characters with at least four digits.
CANDIDATE = rf"(?<!{_TOKEN})(?={_TOKEN}*?[0-9](?:[^0-9\s]{{0,4}}[0-9]){{3}}){_TOKEN}++"
#: Digits in groups, seven at least, and whatever stands around an @.
GROUPED = rf"(?<!{_TOKEN})(?<![0-9][\x20)])[(+]{{0,2}}[0-9]++(?:[\x20().-]{{1,3}}+[0-9]++)++(?!{_TOKEN}*[A-Za-z@])"
AROUND_AT = rf"(?<!{_TOKEN})[A-Za-z0-9._%+-]++@{_DOMAIN}++(?:\.{_DOMAIN}++)*+"
CANDIDATES = {CANDIDATE: "_t RLIKE '[0-9]'", GROUPED: "_t RLIKE r'[0-9][\x20().-]{1,3}[0-9]'", AROUND_AT: "contains(_t, '@')"}
_CONTEXT = r"(?=[^\p{L}]{0,4}(\p{L}{0,24}))"
_SPAN = "array<struct<s:int,e:int,t:string,l:string,r:string>>"


def _let(value: str, name: str, body: str) -> str:
    """Evaluates `value` once and names it within `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def mentions(text: str, expression: str, needs: str | None = None) -> str:
    """SQL for all matches of an expression: array of (s, e, t, l: up to 40 characters before, r: the word after)."""
    marked = f"split(regexp_replace({text}, r'({expression}){_CONTEXT}', '{MARK}$1{RIGHT}$2{MARK}'), '{MARK}')"
    match = f"split(x, '{RIGHT}')"
    inner = (
        f"aggregate(blk, named_struct('at', acc.at, 'odd', false, 'l', acc.l, 'out', cast(array() AS {_SPAN})), (a, x) -> "
        f"if(a.odd, {_let(match, 'm', _step())}, "
        "named_struct('at', a.at + char_length(x), 'odd', true, 'l', right(x, 40), 'out', a.out)))"
    )
    blocks = f"transform(sequence(0, (size(p) - 1) div {BLOCK}), b -> slice(p, b * {BLOCK} + 1, {BLOCK}))"
    zero = f"named_struct('at', 0, 'l', '', 'out', cast(array() AS array<{_SPAN}>))"
    whole = f"aggregate({blocks}, {zero}, (acc, blk) -> {_let(inner, 'i', 'named_struct(\'at\', i.at, \'l\', i.l, \'out\', concat(acc.out, array(i.out)))')}, acc -> flatten(acc.out))"
    found = _let(marked, "p", whole)
    return f"CASE WHEN contains({text}, '{needs}') THEN {found} ELSE cast(array() AS {_SPAN}) END" if needs else found


def _step() -> str:
    end = "a.at + char_length(m[0])"
    return f"named_struct('at', {end}, 'odd', false, 'l', '', 'out', concat(a.out, array(named_struct('s', a.at, 'e', {end}, 't', m[0], 'l', a.l, 'r', m[1]))))"


_DIGIT = "(ascii(substr(d, -i, 1)) - 48)"
LUHN = _let("translate(x.t, ' -', '')", "d", f"aggregate(sequence(1, length(d)), 0, (sum, i) -> sum + if(i % 2 = 1, {_DIGIT}, 2 * {_DIGIT} - if({_DIGIT} > 4, 9, 0))) % 10 = 0")
VALID = {
    "email": None,
    "ip": r"x.t RLIKE r'^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$'",
    "card": LUHN,
    "phone": "length(regexp_replace(x.t, '[^0-9]', '')) BETWEEN 9 AND 15",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What characters a discovered identifier of a kind must have.
SHAPE = {"email": "inst RLIKE '[a-z].*@|@.*[a-z]'", "ip": r"inst RLIKE '^[0-9.:]*[.:][0-9.:]*$'", "card": r"inst RLIKE r'^[0-9\x20-]{8,}$'", "phone": r"inst RLIKE r'^[+0-9().\x20-]{7,}$'"}


_TOLD = "array<struct<x:struct<s:int,e:int,t:string,l:string,r:string>,m:int>>"


def reached(blockers: str, candidates: str, at: str = "{0}.s", value: str = "{0}.e") -> str:
    """SQL: each candidate x with m, the greatest `value` of the blockers whose place `at` isn't behind its own (null: none).

    Both lists are sorted into one, and one pass in blocks carries the greatest value along,
    so thousands of either in one text cost little more than their number.
    """
    b, o = "b", "o"
    both = f"array_sort(concat(transform({blockers}, b -> named_struct('k', {at.format(b)}, 'c', 0, 'v', {value.format(b)}, 'x', cast(NULL AS struct<s:int,e:int,t:string,l:string,r:string>))), transform({candidates}, o -> named_struct('k', {at.format(o)}, 'c', 1, 'v', cast(NULL AS int), 'x', o))))"
    inner = f"aggregate(blk, named_struct('m', acc.m, 'out', cast(array() AS {_TOLD})), (a, y) -> named_struct('m', greatest(a.m, y.v), 'out', if(y.c = 0, a.out, concat(a.out, array(named_struct('x', y.x, 'm', a.m))))))"
    blocks = f"transform(sequence(0, (size(ev) - 1) div {BLOCK}), n -> slice(ev, n * {BLOCK} + 1, {BLOCK}))"
    zero = f"named_struct('m', cast(NULL AS int), 'out', cast(array() AS array<{_TOLD}>))"
    whole = f"aggregate({blocks}, {zero}, (acc, blk) -> {_let(inner, 'i', 'named_struct(\'m\', i.m, \'out\', concat(acc.out, array(i.out)))')}, acc -> flatten(acc.out))"
    alone = f"transform({candidates}, o -> named_struct('x', o, 'm', cast(NULL AS int)))"
    return f"CASE WHEN size({candidates}) = 0 OR size({blockers}) = 0 THEN {alone} ELSE {_let(both, 'ev', whole)} END"


def clear_of(blockers: str, candidates: str) -> str:
    """SQL: the candidates that overlap no blocker: none that starts by their start ends behind it, the next one starts at their end or later."""
    ahead = _let(f"transform(filter({reached(blockers, candidates)}, z -> z.m IS NULL OR z.m <= z.x.s), z -> z.x)", "kept", reached(blockers, "kept", "-{0}.s", "-{0}.s"))
    return f"transform(filter({ahead}, z -> z.m IS NULL OR -z.m >= z.x.e), z -> z.x)"


def base(docs: DataFrame) -> DataFrame:
    """doc_id, _row, spans (array of s, e, k: rank of the kind, t, l, r) and others (identifier-like strings without base spans)."""
    clean = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.expr(f"translate(coalesce(text, ''), '{MARK}{RIGHT}', '\ufffd\ufffd')").alias("_t"))
    columns = {f"_{k}": F.expr(mentions("_t", EXPRESSIONS[k], NEEDS[k])) for k in KINDS}
    found = clean.select("doc_id", "_row", *[c.alias(n) for n, c in columns.items()], *[F.expr(f"CASE WHEN {if_} THEN {mentions('_t', x)} ELSE cast(array() AS {_SPAN}) END").alias(f"_c{i}") for i, (x, if_) in enumerate(CANDIDATES.items())])
    # A token within a group of digits is not a candidate of its own.
    digits = "length(regexp_replace(x.t, '[^0-9]', '')) BETWEEN 7 AND 19"
    found = found.withColumn("_c1", F.expr(f"filter(_c1, x -> {digits})")).withColumn("_c0", F.expr("filter(_c0, x -> NOT contains(x.t, '@'))"))
    apart = f"transform(filter({reached('_c1', '_c0')}, z -> z.m IS NULL OR z.m < z.x.e), z -> z.x)"
    found = found.withColumn("_others", F.expr(f"concat({apart}, _c1, _c2)"))
    kept = [f"transform({f'filter(_{k}, x -> {VALID[k]})' if VALID[k] else f'_{k}'}, x -> named_struct('s', x.s, 'e', x.e, 'k', {i}, 't', x.t, 'l', x.l, 'r', x.r))" for i, k in enumerate(KINDS)]
    spans = found.select("doc_id", "_row", F.expr(f"concat({', '.join(kept)})").alias("spans"), "_others")
    # A candidate must lie clear of base spans; both lists are of one text.
    return spans.select("doc_id", "_row", "spans", F.expr(clear_of("spans", "_others")).alias("others"))


def _lexical(row: str) -> list[Column]:
    """left context (the last word and up to four marks) and instance, in lower case."""
    return [F.lower(F.regexp_extract(f"{row}.l", r"(\p{L}{1,24}[^\p{L}]{0,4})$", 1)).alias("left"), F.lower(f"{row}.r").alias("right"), F.lower(f"{row}.t").alias("inst")]


def discover(found: DataFrame, rounds: int = 3, support: int = 3, trust: float = 0.5, accept: float = 0.8) -> DataFrame:
    """(inst, k): instances that the graph takes for identifiers of kind k. `found`: a written table of base()."""
    seeds = found.select(F.explode("spans").alias("m")).select(F.col("m.k").alias("seed"), *_lexical("m"))
    others = found.select(F.explode("others").alias("m")).select(F.lit(None).cast("int").alias("seed"), *_lexical("m"))
    uses = seeds.union(others).where("left <> ''").distinct()
    patterns = F.array(F.concat(F.lit("L "), "left"), F.when(F.col("right") != "", F.concat(F.lit("B "), "left", F.lit("|"), "right")))
    edges = uses.select("inst", "seed", F.explode(F.array_compact(patterns)).alias("pattern")).distinct()
    sizes = edges.groupBy("pattern").agg(F.countDistinct("inst").alias("n"), F.count("seed").alias("known")).where(F.col("known") >= support)
    # Patterns without enough seeds can't be trusted in any round, so only the others' edges are kept.
    edges = materialize(edges.join(sizes.select("pattern", "n"), "pattern"), "pii_graph")
    scores = edges.where("seed IS NOT NULL").select("inst", F.col("seed").alias("k"), F.lit(1.0).alias("score")).distinct()
    start = scores
    for _ in range(rounds):
        links = edges.select("pattern", "inst", "n").distinct()
        worth = links.join(scores, "inst").groupBy("pattern", "n", "k").agg(F.sum("score").alias("sum"), F.sum((F.col("score") >= accept).cast("int")).alias("known"))
        worth = worth.where(F.col("known") >= support).select("pattern", "k", F.round(F.col("sum") / F.col("n"), 6).alias("worth")).where(F.col("worth") >= trust)
        new = links.join(worth, "pattern").groupBy("inst", "k").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.least("worth", F.lit(0.999))))), 6).alias("score"))
        scores = materialize(start.union(new).groupBy("inst", "k").agg(F.max("score").alias("score")), "pii_scores")
    shaped = F.expr(f"CASE k {' '.join(f'WHEN {i} THEN {SHAPE[k]}' for i, k in enumerate(KINDS))} END")
    known = start.select("inst").distinct()
    taken = scores.where((F.col("score") >= accept) & shaped).join(known, "inst", "left_anti")
    return taken.groupBy("inst").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))


def extract(docs: DataFrame, **graph) -> DataFrame:
    """Per row of docs: doc_id, spans (base) and found (added), arrays of (s, e, k, t); positions are code points, ends exclusive."""
    found = materialize(base(docs), "pii_base", compression="zstd")
    taken = discover(found, **graph)
    mentioned = found.select("_row", F.explode("others").alias("m")).select("_row", "m", F.lower("m.t").alias("inst"))
    added = mentioned.join(taken, "inst").groupBy("_row").agg(F.collect_list(F.struct("m.s", "m.e", "k", "m.t")).alias("found"))
    short = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["t"].alias("t")))
    return found.join(added, "_row", "left").select("doc_id", short.alias("spans"), F.coalesce("found", F.expr("cast(array() AS array<struct<s:int,e:int,k:int,t:string>>)")).alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = extract(load(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(spans, x -> x.k = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.concat("spans", "found")).alias("spans"))
