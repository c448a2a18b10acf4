"""WARC archives, chat rotation, components and the pipeline."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heapscribe.llm import chat, mixing, tokens, warc
from heapscribe.llm.graph import components

from ..conftest import DATA
from .test_text_operators import brute_components, brute_contamination, shingles


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["http://www.Example.com/A?b=1#x", "https://example.com:8080/", "http://b.example.org/z", None, "not a url", "http://[bad"]), rnd.choice(["<p>one</p>", "<p>two é</p>", "", None, f"<p>{i}</p>", "x" * 100_000])) for i in range(300)]
    rows += [(10**12, "http://far.org", "<p>far</p>"), (-(2**62), "http://far.org", None), (400, None, None), (None, "http://c.org", "<p>one</p>"), (5, rows[5][1], rows[5][2])]
    return [(*r, "extra") for r in rows], "page_id long, url string, html string, refers_to string"


def test_external_merge(spark, tmp_path, monkeypatch):
    """Many short runs, merged few at a time and in blocks; one key fills a third of all rows."""
    monkeypatch.setattr(warc, "BLOCK", 8)
    rnd = random.Random(2)
    rows = [{"urlkey": "hot)/" if i % 3 == 0 else f"k{rnd.randrange(40)})/", "ts": f"20{rnd.randrange(24):02d}", "page_id": rnd.choice([None, rnd.randrange(50)]), "url": "u", "archive": f"a{i % 5}", "offset": i, "length": 1, "payload_bytes": 2, "payload_digest": "d", "record_type": "response", "refers_to": None} for i in range(2000)]
    blocks = [warc.write_run(f"file://{tmp_path}/runs", sorted(rows[k::37], key=warc._order)) for k in range(37)]
    df = spark.createDataFrame(pa.Table.from_batches(blocks)).repartition(3)
    got = [r.asDict() for r in warc.merge_runs(df, fan=3).collect()]
    assert got == sorted(rows, key=warc._order)
    widest = warc.merge_runs(df, fan=64)
    sizes = widest.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 900 and widest.count() == 2000


@pytest.mark.parametrize("least", [0, 12])
def test_warc(spark, pages, tmp_path, least):
    rows, schema = pages
    folder = f"file://{tmp_path}/{least}"
    manifest = warc.write_archives(spark.createDataFrame(rows, schema).repartition(3), folder, least=least, archive_bytes=20_000)
    runs = warc.read_runs(spark, manifest)
    got = warc.merge_runs(runs).collect()
    winners = {}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= least:
            winners[raw] = max(i, winners.get(raw, i))
    want = Counter()
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        keeper = winners.get(raw)
        revisit = keeper is not None and i != keeper and len(raw) >= least
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert [warc._order(r.asDict()) for r in got] == sorted(warc._order(r.asDict()) for r in got)
    dated = spark.createDataFrame([(i, None, "x", d) for i, d in enumerate((-(10**12), 0, 10**12, None))], "page_id long, url string, html string, s long")
    stamped = warc.write_archives(dated, folder + "-dated", when=F.timestamp_seconds("s"))
    assert sorted(r.ts[:4] for r in warc.merge_runs(warc.read_runs(spark, stamped)).collect()) == ["0001", "1970", "2024", "9999"]
    empty = warc.write_archives(spark.createDataFrame([], schema), folder + "-empty")
    assert warc.merge_runs(warc.read_runs(spark, empty)).count() == 0


def test_loser_tree():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def brute_chat(rows):
    out, convs = {}, {}
    safe = lambda s: s.replace("<|", "<\\|")
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, safe(role) if role is not None else "unknown", safe(text or "")))
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        for who in {t[1] for t in turns} - {"system"}:
            text, mask = "", []
            for _, role, body in turns:
                text += {"system": "<|im_start|>system\n", who: "<|im_start|>assistant\n"}.get(role, f"<|im_start|>user name={role}\n")
                if role == who:
                    mask.append((len(text), len(text) + len(body) + 10))
                text += body + "<|im_end|>\n"
            out[conv, who] = text, mask
    return out


@pytest.mark.parametrize("part", [1, 3, 256])
def test_chat(spark, part):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["ann", "bob", "system", None, "<|x"]), rnd.choice(["hi", "", None, "é\U0001f600", "<|im_end|>", "long " * 50])) for c in range(30) for t in range(rnd.randrange(9))]
    rows += [(90, 0, "system", "alone"), (91, 3, "ann", "x"), (91, 3, "ann", "x"), (None, 1, "bob", "none"), *[(92, t, "ann" if t % 2 else "bob", str(t)) for t in range(900)]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, speaker string")
    got = {}
    for r in sorted(chat.rotate(df, part).collect(), key=lambda r: r.part):
        text, mask, n = got.get((r.conv_id, r.speaker), ("", [], 0))
        assert r.start == len(text) and r.first_turn == n + 1 and r.n_own == len(r["mask"])
        got[r.conv_id, r.speaker] = text + r.text, mask + [(m.s + r.start, m.e + r.start) for m in r["mask"]], n + r.n_turns
    assert {k: v[:2] for k, v in got.items()} == brute_chat(rows)
    assert {(r.conv_id, r.speaker): (r.text, [(m.s, m.e) for m in r["mask"]]) for r in chat.rotate(df, None).collect()} == brute_chat(rows)
    assert chat.rotate(df.where("false")).count() == 0


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names, rows = [n for n, _ in corpus_pipeline.STAGES], {}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == docs.columns
        rows[name] = before.collect(), after.collect()
        before = after
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in rows[names[0]][1]}
    asked = good & {r.doc_id for r in rows[names[0]][0]}
    assert len(asked & kept) >= 0.97 * len(asked)
    was, now = rows[names[1]]
    groups = brute_components([shingles(r.text, 5) for r in was], 80)
    assert sorted(r.doc_id for r in now) == sorted([min(was[i].doc_id for i in g) for g in groups])
    was, now = rows[names[2]]
    hit = lambda n, h, _: h > 0 and 20 * h >= n
    assert {r.doc_id for r in now} <= {r.doc_id for r in was}
    dropped = [r for r in was if r.doc_id not in {x.doc_id for x in now}]
    assert all(hit(*brute_contamination(r.text, bench)) for r in dropped)
    short = [r for r in now if len(r.text or "") < 1500][:15]
    assert not any(hit(*brute_contamination(r.text, bench)) for r in short)
    was, now = rows[names[3]]
    times = Counter(r.doc_id for r in now)
    assert set(times) <= {r.doc_id for r in was} and max(times.values()) <= 3
    out = corpus_pipeline.run(spark, DATA).orderBy("start").collect()
    assert Counter(r.doc_id for r in out) == times and [r.doc_id for r in out] == sorted(r.doc_id for r in out)
    assert out[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False))


def test_pipeline_near_duplicates_on_five_words(spark):
    """One changed word in the middle of 50: 41/51 on five words, 45/51 on three."""
    rows = []
    for i in range(20):
        words = [f"{i}w{k}" for k in range(40 + i)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:20], "other", *words[21:]]))]
    sets = [shingles(t, 5) for _, t in rows]
    want = [min(rows[i][0] for i in g) for g in brute_components(sets, 80)]
    got = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and 20 < len(want) < 40


def test_pipeline_tells_rows_of_one_doc_id_apart(spark):
    text = lambda k, n=60: " ".join(f"{k}w{j}" for j in range(n))
    rows = [(5, text("a"), "s"), (None, text("a", 61), "s"), (None, text("b"), "s"), (None, text("c"), "t"), (7, text("d"), "s"), (7, text("e"), "s"), (7, text("e"), "s"), (7, text("d", 61), "t"), (None, None, "s"), (8, "", "s"), (8, "", "s"), (9, text("f"), "u")]
    rows += [(None, text("g"), "s"), (None, text("g", 61), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    kept = corpus_pipeline.deduplicate(spark, docs, DATA).cache()
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    either = [(7, text("d")), (7, text("d", 61))], [(None, text("g")), (None, text("g", 61))]
    for pair in either:
        assert sum(got.pop(x, 0) for x in pair) == 1
    assert got == Counter([(5, text("a")), (None, text("b")), (None, text("c")), (7, text("e")), (None, None), (8, ""), (8, ""), (9, text("f"))])
    for given in (kept, docs):
        taken = Counter()
        for r in mixing.mix(given.withColumn("k", F.xxhash64("text")), key="k").join(given.select(F.xxhash64("text").alias("k"), "text").distinct(), "k").collect():
            taken[r.doc_id, r.source, r.text] += r.taken // max(r["size"], 1)
        assert Counter((r.doc_id, r.source, r.text) for r in corpus_pipeline.mix(spark, given, DATA).collect()) == +taken


def test_pipeline_carries_columns_of_any_name(spark):
    names = ["_id", "_rows", "_times", "_n", "_key", "key", "kept", "copies", "times", "at", "node", "w", "bits", "row_key", "size", "d_text", "score", "target"]
    rows = [(i, " ".join(f"{i}{c}" for c in "abcdefghijkl"), "en", "s", 9, *[f"{i}{n}" for n in names]) for i in range(12)]
    rows += [(20, rows[3][1] + " more", "en", "s", 9, *["x"] * len(names)), (7, rows[7][1], *rows[7][2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    once = corpus_pipeline.deduplicate(spark, docs, DATA)
    assert once.columns == docs.columns and sorted(tuple(r) for r in once.collect()) == sorted(rows[:12])
    for stage in (corpus_pipeline.classify, corpus_pipeline.decontaminate, corpus_pipeline.mix):
        got = stage(spark, once, DATA)
        assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(rows)
    assert {r.doc_id for r in corpus_pipeline.tokenize(spark, once, DATA).collect()} == set(range(12))


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, "a few words here", "en", "s", 16, 0.5), (1, "a few words here", "en", "s", 16, 0.5), (2, None, None, None, None, None), (3, "", "en", "t", 0, 0.1), (None, "no id at all", "en", "t", 12, 0.2), (4, "w " * 40_000, "en", None, 9, 0.3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    for name, made in (("some", rows), ("none", [])):
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(0, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r.doc_id for r in out} <= {1, 4, None} and len(out) > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_tokens_of_one_row_are_whole(spark):
    text = " ".join(f"w{np.base_repr(i * 7919, 36)}" for i in range(60_000))
    got = tokens.token_rows(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    from tokenizers import Tokenizer

    assert got.n_tokens == len(Tokenizer.from_file(tokens.default_vocabulary()).encode(text, add_special_tokens=False).ids) + 1
