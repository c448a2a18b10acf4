"""Operators on documents against brute-force versions on small tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from heapscribe.llm import fmindex, jaccard, lines, mixing, pii, quality, tiff, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key long, node long, spans string, n_words long, part int"
SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def table(spark, rows):
    """rows of (doc_id, text[, source]); the other columns have names that operators use inside."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", 7, 0.5, 1, 2, 3, "x", 4, 5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n=60):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ka", "lo", "mi", "Ne", "ru", "sé") for b in ("ta", "r", "n", "lis", "mo")]
    return [" ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randint(4, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = prose(1)
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(100 + i, t) for i, t in enumerate(texts[:10])]  # exact copies
    for i, t in enumerate(prose(2, 12)):
        base = (t + " ") * 6
        words = base.split()
        out.append((200 + 3 * i, base))
        out.append((201 + 3 * i, " ".join(words[:-1] + ["altered"])))
        out.append((202 + 3 * i, " ".join(["first", *words])))
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "ONE"), (305, "one two"), (306, "long " * 30_000), (307, "a b \U0001f600 c" * 3)]
    out += [(5, texts[5]), (None, texts[6]), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_tiff_round_trip(docs, empty, rows):
    got = tiff.digests(tiff.pages(tiff.store(docs))).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in ((r[0], (r[1] or "").encode()) for r in rows):
        payload = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        want[i, len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert tiff.digests(tiff.pages(tiff.store(empty))).count() == 0


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_codecs(codec, predictor):
    rng = np.random.default_rng(codec + predictor)
    for shape in ((1, 1), (5, 7), (64, 64), (300, 130)):
        for a in (rng.integers(0, 256, shape, dtype=np.uint8), np.zeros(shape, np.uint8), rng.integers(0, 2, shape, dtype=np.uint8) * 255):
            strip = {"samples": a, "compression": codec, "predictor": predictor, "rows_per_strip": 3}
            tile = {"samples": a, "compression": codec, "predictor": predictor, "tile": (16, 32)}
            pages = list(tiff.read_tiff(tiff.write_tiff([strip, tile])))
            assert [p["samples"] for p in pages] == [a.tobytes()] * 2 and [p["tiled"] for p in pages] == [False, True]


def hand_made(order, tags, data, short=()):
    """A TIFF of one directory, spelled out: data at 8, then the directory; each tag has one value of type LONG, or SHORT if named."""
    at = 8 + len(data) + len(data) % 2
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + data + b"\0" * (len(data) % 2) + struct.pack(order + "H", len(tags))
    for tag, value in sorted(tags.items()):
        out += struct.pack(order + "HHI", tag, 3 if tag in short else 4, 1) + (struct.pack(order + "HH", value, 0) if tag in short else struct.pack(order + "I", value))
    return out + bytes(4)


PACKED = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")  # the example of the PackBits note, and what it stands for
UNPACKED = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_reads_files_of_other_writers(order):
    base = {256: 24, 257: 1, 258: 8, 259: 32773, 262: 1, 273: 8, 277: 1, 278: 1, 279: len(PACKED)}
    (page,) = tiff.read_tiff(hand_made(order, base, PACKED, (256, 258, 259, 277)))
    assert page["samples"] == UNPACKED
    (page,) = tiff.read_tiff(hand_made(order, base | {256: 8, 277: 3}, PACKED))
    assert page["samples"] == UNPACKED and page["samples_per_pixel"] == 3
    rgb = bytes([10, 20, 30, 1, 2, 255, 0, 0, 2])  # differences by sample: (10, 20, 30), (11, 22, 29), (11, 22, 31)
    (page,) = tiff.read_tiff(hand_made(order, base | {256: 3, 259: 1, 277: 3, 279: 9, 317: 2}, rgb))
    assert page["samples"] == bytes([10, 20, 30, 11, 22, 29, 11, 22, 31])
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 258, 6, 6, 257))  # 7, 7 7, 7 7, 6, 6
    packed = int(codes.ljust(64, "0"), 2).to_bytes(8, "big")
    (page,) = tiff.read_tiff(hand_made(order, base | {256: 7, 259: 5, 279: 8}, packed))
    assert page["samples"] == bytes([7, 7, 7, 7, 7, 6, 6])


def test_tiff_broken_media(spark):
    base = {256: 24, 257: 1, 258: 8, 259: 32773, 262: 1, 273: 8, 277: 1, 278: 1, 279: len(PACKED)}
    tile = {k: v for k, v in base.items() if k not in (273, 278, 279)} | {322: 24, 323: 16, 324: 8, 325: len(PACKED)}
    changes = [base | x for x in ({256: 0}, {257: 0}, {278: 0}, {277: 0}, {256: 2**31 - 1, 257: 2**31 - 1}, {284: 2}, {266: 2}, {258: 16}, {259: 7}, {317: 3}, {273: 1 << 30}, {257: 5})] + [tile | {322: 0}, tile | {323: 0}, tile | {322: 1 << 31}]
    broken = [None, b"", b"II*\0\xff\0\0\0", *[hand_made("<", c, PACKED) for c in changes]]
    rows = [(i, 0, None if x is None else bytearray(x)) for i, x in enumerate(broken)] + [(100, 24, bytearray(hand_made(">", base, PACKED)))]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in tiff.pages(df).collect()}
    assert len(got) == len(rows) and all(got[i].error and got[i].n_pages == 0 for i in range(len(broken)))
    assert got[100].error is None and bytes(got[100].samples) == UNPACKED
    folded = {r.doc_id: r for r in tiff.digests(tiff.pages(df)).collect()}
    assert len(folded) == len(rows) and folded[100].payload_bytes == 24
    assert all(folded[i].payload_bytes is None and folded[i].feature is None for i in range(len(broken)))


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * left / total > repeats * sizes[s]} if total else set()
        if not over:
            return out | {s: w[s] * left / total for s in open_}
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= over


def test_mixing(spark, empty):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["a", "a", "a", "b", "Z", None, "é"])) for i in range(800)] + [(7, "again and again", "a"), (None, "no id", "b"), (900, None, "a")]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(SPACE, t or ""))
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 95, (s, taken[s], t)
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(empty).count() == 0


def test_quality(spark, docs, empty, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r[-1] <= 1 for r in got)
    none = quality.learn(docs, labels.where("false"))
    assert {r[-1] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_quality_sees_words(spark):
    """Two kinds of text that differ in their words alone: same lengths, same marks."""
    rnd = random.Random(3)
    kinds = ["alpha", "gamma", "delta", "sigma", "omega"], ["apple", "grape", "lemon", "melon", "mango"]
    rows = [(i, " ".join(rnd.choice(kinds[i % 2]) for _ in range(30))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    got = quality.score(docs, quality.learn(docs, labels)).where("doc_id >= 300").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got) >= 97


def test_quality_votes_are_exact():
    rng = np.random.default_rng(0)
    x = (rng.random((300, quality.TERMS)) < 0.02).astype(np.float32)
    y = rng.integers(0, 2, 300)
    m = quality.fit(x, y)
    q = (rng.random((40, quality.TERMS)) < 0.02).astype(np.float32)
    p = m.project(q)
    for row, s in zip(p, m.score(q), strict=True):
        sims = m.vectors @ row
        near = np.argsort(-sims)[: quality.NEIGHBOURS]
        w = np.maximum(sims[near], 0).astype(float) ** quality.POWER
        assert abs(s - (w * y[near]).sum() / w.sum()) < 1e-5


def test_quality_held_out_accuracy(spark):
    from heapscribe.llm.quality import op3_quality

    got = op3_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    hits = [(r.predicted == r.quality) for r in got]
    assert len(hits) > 300 and sum(hits) / len(hits) > 0.9


def shingles(text, n):
    w = re.findall(SPACE, lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(sets, num=90, den=100):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[root(i)].append(i)
    return groups.values()


@pytest.mark.parametrize(("size", "num"), [(3, 90), (1, 80), (2, 60)])
def test_jaccard(docs, empty, rows, size, num):
    sets = [shingles(r[1], size) for r in rows]
    want = Counter()
    for g in brute_components(sets, num):
        ids = [rows[i][0] for i in g]
        for i in g:
            least = min((x for x in ids if x is not None), default=None)
            want[rows[i][0], len(sets[i]), least if sets[i] else rows[i][0]] += 1
    assert Counter(tuple(r) for r in jaccard.join(docs, size, num).select("doc_id", "n_shingles", "component_id").collect()) == want
    assert jaccard.join(empty).count() == 0


def test_jaccard_small_sets_and_tiles(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.sample("abcdefghijklmnop", rnd.randint(1, 14)))) for i in range(300)]
    base = [f"w{i}" for i in range(40)]
    rows += [(1000 + i, " ".join(base[:i % 3] + [f"x{i}"] + base[i % 5 :])) for i in range(60)]
    monkeypatch.setattr(jaccard, "TILE_DOCS", 7)
    for num in (90, 80):
        sets = [shingles(r[1], 1) for r in rows]
        want = {rows[i][0]: min(rows[j][0] for j in g) for g in brute_components(sets, num) for i in g}
        assert {r.doc_id: r.component_id for r in jaccard.join(table(spark, rows), 1, num).collect()} == want


def test_jaccard_where_light_and_heavy_sizes_overlap(spark):
    """A pointer that a list and a shared subset both give: x's link to y goes through a list whose first member, h, links with x only."""
    rows = []
    for i in range(250):
        x = [f"{i}w{k}" for k in range(20 + i % 3)]
        rows += [(3 * i, " ".join(x)), (3 * i + 1, " ".join([*x, "more"])), (3 * i + 2, " ".join([*x[:-1], "other"]))]
    sets = [shingles(t, 3) for _, t in rows]
    want = {}
    for i in range(0, len(rows), 3):
        for g in brute_components(sets[i : i + 3]):
            want |= {rows[i + k][0]: min(rows[i + j][0] for j in g) for k in g}
    assert {r.doc_id: r.component_id for r in jaccard.join(table(spark, rows)).collect()} == want


@pytest.mark.parametrize("hot", [1, 8])
def test_jaccard_unrelated_long_texts_are_no_candidates(spark, hot, monkeypatch):
    """A passage of 60 words in all of 300 long unrelated texts: no two of these become a candidate pair."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([f"{i}w{k}" for k in range(50 + i)] + passage + [f"{i}v{k}" for k in range(20)])) for i in range(300)]
    rows += [(1000, rows[5][1] + " more"), (1001, " ".join(passage)), (1002, " ".join([*passage, "x"]))]
    docs = table(spark, rows)
    cells, classes = jaccard.hot_shingles(docs, 3)
    assert (classes == 8).sum() == 58
    nodes = jaccard.signed(docs, 3, 90, 100).select("node", jaccard.F.col("n_shingles").alias("n"), "heavy", "light", "signature").cache()
    assert jaccard.candidates(nodes, 90, 100).count() == 2
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {i: {1000: 5, 1002: 1001}.get(i, i) for i, _ in rows}


def test_jaccard_long_lists(spark, monkeypatch):
    """Lists longer than SMALL_LIST, in one tile and in several: chains of near copies and some that link with none."""
    base = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join([f"{i}x{k}" for k in range(i % 4)] + base[i % 3 :] + [f"{i}y"] * (i % 2))) for i in range(120)]
    sets = [shingles(t, 1) for _, t in rows]
    want = {rows[i][0]: min(rows[j][0] for j in g) for g in brute_components(sets, 90) for i in g}
    for tile in (4096, 8):
        monkeypatch.setattr(jaccard, "TILE_LIST", tile)
        assert {r.doc_id: r.component_id for r in jaccard.join(table(spark, rows), 1, 90).collect()} == want


def brute_contamination(text, items, window=13):
    w = re.findall(ALNUM, lower(text or ""))
    hit, found = set(), set()
    for i, t in items:
        iw = re.findall(ALNUM, lower(t or ""))
        for at in range(max(1, len(iw) - window + 1) if iw else 0):
            win = iw[at : at + window]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(i)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, empty, block, monkeypatch):
    monkeypatch.setattr(fmindex, "SHARD", 300)
    texts = [t.replace(",", " ") for t in prose(4, 30)]
    items = [(i, t) for i, t in enumerate(texts[:8])] + [(20, "single"), (21, "two words"), (22, None), (23, "..."), (24, texts[0])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[1][7:] + " tail " + texts[2].upper()), (51, None), (52, ""), (53, "single two-words, single"), (54, ("pad " * 50 + texts[3] + " ") * 3), (None, texts[4]), (3, texts[3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = fmindex.decontaminate(table(spark, rows), bench, block_windows=block).collect()
    want = Counter()
    for i, t in rows:
        n, h, found = brute_contamination(t, items)
        want[i, n, h, tuple(found), h > 0 and 20 * h >= n] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in got) == want
    assert fmindex.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in fmindex.decontaminate(table(spark, rows), bench.where("false")).select("contaminated").collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rnd, s, n):
    for _ in range(n):
        at, op = rnd.randrange(len(s) + 1), rnd.randrange(3)
        s = s[:at] + ("" if op == 0 else rnd.choice("abxyé\U0001f600")) + s[at + (op != 1) :]
    return s


@pytest.mark.parametrize("tau", [1, 2, 3, 5])
def test_banded_edit_distance(tau):
    rnd, pairs = random.Random(tau), []
    for _ in range(400):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40)))
        pairs.append((a, edited(rnd, a, rnd.randint(0, tau + 2)) if rnd.random() < 0.8 else "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40)))))
    got = lines.within([lines._points(a) for a, _ in pairs], [lines._points(b) for _, b in pairs], tau)
    assert [bool(x) for x in got] == [distance(a, b) <= tau for a, b in pairs]


@pytest.mark.parametrize("pairs", [4, 0])
def test_line_dedup(spark, empty, pairs, monkeypatch):
    """With 0 pairs for each member, lists go through the tiles."""
    monkeypatch.setattr(lines, "PAIRS_A_MEMBER", pairs)
    monkeypatch.setattr(lines, "TILE", 16)
    rnd, pool = random.Random(5), [t[:90] for t in prose(6, 40)]
    pool += [edited(rnd, t, rnd.randint(1, 3)) for t in pool for _ in range(3) if len(t) > 5] + ["short", "Short", "twelve point", "twelve poinT", "twelve points", "twelve pointed", "eleven poin", "eleven poiN", "", "   ", "x" * 3000, "x" * 3001]
    pool += [f"a common beginning of all lines {i:05d} and its common end" for i in range(0, 90_000, 700)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8)))) for i in range(150)] + [(None, "short"), (200, None), (200, "short")]
    got = lines.dedup(table(spark, rows))
    texts = sorted({x for _, t in rows for x in (t or "").split("\n") if x and not x.isspace()})
    parent = {t: t for t in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= 12 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 12):
                parent[root(a)] = root(b)
    seen, want = set(), Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        own, removed = [x for x in (t or "").split("\n") if x and not x.isspace()], []
        for k, x in enumerate(own):
            if root(x) in seen:
                removed.append(k)
            seen.add(root(x))
        want[i, len(own), len(own) - len(removed), tuple(removed)] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_kept, tuple(r.removed)) for r in got.collect()) == want
    assert lines.dedup(empty).count() == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, t):
    d = re.sub("[^0-9]", "", t)
    luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in t.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def brute_pii(text):
    found = [(m.start(), k, m.end()) for k, (_, rx) in enumerate(PII.items()) for m in re.finditer(rx, text or "") if valid(list(PII)[k], m[0])]
    return sorted(found)


def test_lines_that_every_task_holds(spark):
    """A hot line, and near copies of it, in all of many partitions: each list has it once."""
    common = "This very line stands in every single document of the set"
    rows = [(i, f"{common}\nown line number {i} of document {i * 7919} only\n{common + ('!' if i % 2 else '')}") for i in range(300)]
    got = {r.doc_id: r for r in lines.dedup(table(spark, rows).repartition(30)).collect()}
    assert got[0].removed == [2] and all(set(got[i].removed) >= {0, 2} for i in range(1, 300))


def test_pii_base_spans(spark, empty):
    rnd = random.Random(8)
    parts = ["a@b.c", "x.y+z@mail-1.example.org", "a@b.c_d@e.f", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234567890123", "+1 (234) 555-6789", "+1", "+12 3", "é", "\U0001f600", "", "$1", "word", " ", " ", "\n", "-", "7", "79927398713", "0000 0000 0000"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, "5" * 10_000), (703, "a" * 10_000), (704, "a@b.c " * 9_000), (705, "a@b" + ".c" * 9_000), (706, "1 " * 20_000), (None, "q@r.st"), (5, rows[5][1])]
    got = pii.extract(table(spark, rows)).collect()
    assert Counter((r.doc_id, tuple(sorted((x.s, x.k, x.e) for x in r.spans))) for r in got) == Counter((i, tuple(brute_pii(t))) for i, t in rows)
    assert pii.extract(empty).count() == 0


def test_pii_clears_candidates_as_all_pairs_do(spark):
    from pyspark.sql import functions as F

    rnd, rows = random.Random(4), []
    for k in range(150):
        n, width = rnd.choice([0, 1, 3, 40, 700]), rnd.choice([20, 300, 6000])
        make = lambda: [(a := rnd.randrange(width), a + rnd.randint(1, 12), "t", "", "") for _ in range(rnd.randint(0, n))]  # noqa: B023, E731
        rows.append((k, make(), make()))
    kind = "array<struct<s:int,e:int,t:string,l:string,r:string>>"
    df = spark.createDataFrame(rows, f"k int, b {kind}, c {kind}").repartition(4)
    got = df.select("k", F.expr(pii.clear_of("b", "c")).alias("clear"), F.expr(pii.reached("b", "c")).alias("m")).collect()
    for r in got:
        _, b, c = rows[r.k]
        assert sorted((x.s, x.e) for x in r.clear) == sorted(o[:2] for o in c if not any(x[0] < o[1] and o[0] < x[1] for x in b))
        assert sorted((z.x.s, z.x.e, z.m or -1) for z in r.m) == sorted((*o[:2], max((x[1] for x in b if x[0] <= o[0]), default=-1)) for o in c)


def test_pii_of_one_text_grows_with_its_length(spark):
    import time

    pii.extract(table(spark, [(1, "a@b.cd x 12345")])).collect()
    took = []
    for n in (2000, 16_000):
        text = " ".join(f"user{i}@mail{i % 7}.example.org id-{i:06d}-x" for i in range(n))
        began = time.time()
        (row,) = pii.extract(table(spark, [(1, text)])).collect()
        took.append(time.time() - began)
        assert len(row.spans) == n
    assert took[1] < 3 * 8 * max(took[0], 1)


def test_pii_discovers_unseen_identifiers(spark):
    seeds = [(i, f"Please call the office phone: +1 555 010 20{i:02d} for details.") for i in range(9)]
    unseen = [(50, "Please call the office phone: 5550107788 for details."), (51, "There are 5550100000 grains of sand, or 12345678 more.")]
    got = {r.doc_id: r for r in pii.extract(table(spark, seeds + unseen)).collect()}
    assert [(x.s, x.e, x.k) for x in got[50].found] == [(30, 40, pii.KINDS.index("phone"))]
    assert not got[51].found and all(not got[i].found and len(got[i].spans) == 1 for i in range(9))


@pytest.mark.parametrize(
    ("kind", "before", "seeds", "unseen", "others"),
    [
        ("phone", "call the office phone: ", [f"+1 555 010 20{i:02d}" for i in range(9)], ["020 7946 0958", "(555) 010 7788", "555.010.7789", "010-5550-7788"], ["in 2024 and 17 more"]),
        ("card", "paid with card number ", [f"4111 1111 1111 {x}" for x in ("1111", "1129", "1137", "1145", "1152", "1160", "1178", "1186", "1194")], ["4111 1111 1111 1112", "5500-0000-0000-0005"], ["12 of 17"]),
        ("email", "write to the address ", [f"user{i}@mail.example.org" for i in range(9)], ["jane.doe@intranet", "root@localhost"], ["at home @ noon"]),
    ],
)
def test_pii_discovers_usual_forms(spark, kind, before, seeds, unseen, others):
    """Identifiers that no base pattern has, in contexts that seeds have shown; the same strings elsewhere stay."""
    rows = [(i, f"Please {before}{x} today.") for i, x in enumerate([*seeds, *unseen])]
    rows += [(100 + i, f"There was nothing, {x}, to see.") for i, x in enumerate(others)]
    got = {r.doc_id: r for r in pii.extract(table(spark, rows)).collect()}
    for i, x in enumerate(unseen):
        at = len("Please ") + len(before)
        spans = [(s.s, s.e, pii.KINDS[s.k]) for s in [*got[len(seeds) + i].spans, *got[len(seeds) + i].found]]
        assert (at, at + len(x), kind) in spans, (x, spans)
    assert all(not got[100 + i].found for i in range(len(others)))


def test_tokens_without_ids_spread_over_files(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = [(None, f"text number {i}") for i in range(3000)]
    path = f"file://{tmp_path}/tokens"
    tokens.write_tokens(table(spark, rows).repartition(5), path, tokens.default_vocabulary())
    stored = tokens.read_tokens(spark, path)
    assert stored.count() == 3000 and max(r["count"] for r in stored.groupBy("part").count().collect()) < 1500
    starts = sorted((r.start, r.n_tokens) for r in tokens.summary(stored).collect())
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_tokens_round_trip(spark, docs, empty, rows, encoding, tmp_path):
    from tokenizers import Tokenizer

    path, t = f"file://{tmp_path}/t", Tokenizer.from_file(tokens.default_vocabulary())
    more = table(spark, [(i, x) for i, x in rows] + [(400, "<|endoftext|> special"), (401, "  two  spaces \n\n x"), (402, "tab\tand 　wide")])
    tokens.write_tokens(more, path, tokens.default_vocabulary(), encoding=encoding)
    stored = tokens.read_tokens(spark, path)
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [tokens.END_ID] for i, x in more.select("doc_id", "text").collect() if i is not None}
    assert {r.doc_id: r.tokens for r in stored.collect() if r.doc_id is not None} == want
    assert {r.doc_id for r in tokens.read_tokens(spark, path, 100, 120).collect()} == {i for i in want if 100 <= i <= 120}
    at = 0
    got = tokens.summary(stored).orderBy(tokens.F.col("doc_id").asc_nulls_first(), "start").collect()
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes())
    assert len(got) == more.count() and tokens.token_rows(empty).count() == 0


def test_tokens_of_equal_ids_stand_in_stored_order(spark):
    rows = [(i % 3, None if i % 17 == 0 else f"text {i % 50} " * (i % 7)) for i in range(200)]
    got = tokens.token_rows(table(spark, rows)).collect()
    at, lengths = 0, {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        lengths.setdefault(r.doc_id, []).append(r.n_tokens)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    for i in range(3):
        own = sorted((x for d, x in rows if d == i), key=lambda x: (x is not None, (x or "").encode()))
        assert lengths[i] == [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in own]
