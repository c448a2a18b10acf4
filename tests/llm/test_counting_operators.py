"""Divergence audit, cached token counts and resampling against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from heapscribe.llm import counting, divergence, resampling

SCHEMA = "doc_id long, text string, lang string, source string, term string, docs long, n long, digest string, total boolean, weight long, chunk long"
TERM, WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def table(spark, rows):
    """rows of (doc_id, text, lang, source); the other columns have names that operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", True, 3, 4) for r in rows], SCHEMA)


def prose(seed, n):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "Gámma", "DELTA", "eps1lon", "zeta", "Éta", "theta_x", "日本", "kappa's", *[f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(24)]]
    return [" ".join(rnd.choice(words[: rnd.randint(3, len(words))]) + rnd.choice(["", ",", ". ", "  ", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = [(i, t, rnd.choice(["en", "en", "de"]), rnd.choice(["a", "b", "é", "c"])) for i, t in enumerate(prose(3, 150))]
    out += [(200 + i, "the same text in many places", "en", "a") for i in range(60)]
    out += [(300, None, "en", "void"), (301, "", None, None), (302, "Once only", "fr", "a"), (303, "twice only", "fr", "b"), (304, " \n ", "en", "b"), (305, "long word " * 40_000, "en", "c"), (None, "no id here beta beta", "en", None), (5, out[5][1], out[5][2], out[5][3])]
    return out


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(TERM, lower(text))) for _, text, lang, source in rows]
    df = defaultdict(Counter)
    for lang, _, words in docs:
        df[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in df.items()}
    groups, whole = {(a, b): Counter() for a, b, _ in docs}, defaultdict(Counter)
    for lang, source, words in docs:
        known = [w for w in words if w in set(kept[lang])]
        groups[lang, source].update(known)
        whole[lang].update(known)
    share = lambda c, lang: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept[lang])) for t in kept[lang]}
    p, q, out = {g: share(c, g[0]) for g, c in groups.items()}, {lang: share(whole[lang], lang) for lang in kept}, []
    for lang, source in groups:
        pairs = [(sum((p[lang, source][t] - p[lang, o][t]) ** 2 // p[lang, o][t] for t in kept[lang]), o) for at, o in groups if at == lang and o != source]
        terms = [((p[lang, source][t] - q[lang][t]) ** 2 // q[lang][t], t) for t, n in groups[lang, source].items() if n and p[lang, source][t] > q[lang][t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("parts,size", [(3, 1 << 23), (5, 300)])
def test_audit_is_brute_force(spark, rows, parts, size, monkeypatch):
    whole = divergence.chunks
    monkeypatch.setattr(divergence, "chunks", lambda docs: whole(docs, size))
    monkeypatch.setattr(divergence, "PAIRS", 64)
    got = divergence.audit(table(spark, rows).repartition(parts))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows)


def test_audit_ranks_end_at_the_top(spark, rows):
    assert sorted(map(tuple, divergence.audit(table(spark, rows), top=4).collect())) == brute_audit(rows, top=4)


def test_shares_are_exact_for_any_count():
    import numpy as np

    rnd = random.Random(2)
    pairs = [(n := rnd.randrange(10**k), n + rnd.randrange(1, 10 ** rnd.randint(1, 15))) for k in range(1, 15) for _ in range(50)]
    got = divergence.share(np.array([n for n, _ in pairs]), np.array([w for _, w in pairs]))
    assert got.tolist() == [1 + 10**9 * (n + 1) // w for n, w in pairs]


def test_audit_keeps_the_hot_source_whole(spark):
    rows = [(i, f"common term{'abcdef'[i % 6]} again", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(4000)]
    assert sorted(map(tuple, divergence.audit(table(spark, rows).repartition(20)).collect())) == brute_audit(rows)


def test_audit_of_nothing(spark):
    assert divergence.audit(table(spark, [])).count() == 0
    few = divergence.audit(table(spark, [(1, "one", "en", "a"), (2, None, "en", "b")])).collect()
    assert sorted((r.source, r.part, r.item, r.value, r["rank"]) for r in few) == [("a", "pair", "b", 0, 1), ("b", "pair", "a", 0, 1)]


# --- token counts ----------------------------------------------------------------------------


def library_counts(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [len(x) for x in library.encode(texts)]


ODD = ["", " ", "  ", "a ", " a", "a  b", "a▁b", "▁", "▁ ▁a", "a ▁", "\n a\t b", "<s> x </s>", "<unk>", "日本語 テキスト", "x　y", "\U0001f600 \U0001f600", "é é", "\x00 a", "<0x0A>", "   \n   ", "aaaa " * 50]


def test_piece_counts_are_the_library_s():
    rnd = random.Random(9)
    texts = ODD + prose(4, 60) + ["".join(rnd.choice("ab ▁\n.,é1<>s/") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    for memory in (1_000_000, 50):
        assert counting.PieceCounter(counting.default_vocabulary(), memory)(texts) == library_counts(texts)
    whole = counting.PieceCounter(counting.default_vocabulary())
    whole.by_word = False
    assert whole(texts) == library_counts(texts)


@pytest.fixture
def cache(tmp_path):
    return f"file://{tmp_path}/counts"


def check_counts(got, rows):
    texts = [r[1] or "" for r in rows]
    want = [(r[0], len(t.encode()), n, n > 4096) for r, t, n in zip(rows, texts, library_counts(texts), strict=True)]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_counts_and_what_the_cache_saves(spark, rows, cache, monkeypatch):
    rows = rows + [(400 + i, t, "en", "a") for i, t in enumerate(ODD)]
    check_counts(counting.count_tokens(table(spark, rows[:100]).repartition(3), cache), rows[:100])
    tokenizer = counting.version(counting.default_vocabulary())
    before = counting.stored(spark, cache, tokenizer).count()
    assert before == len({(r[1] or "").replace("▁", " ") for r in rows[:100]})
    docs = table(spark, rows).repartition(7)
    new = counting.misses(docs, counting.stored(spark, cache, tokenizer), counting.default_vocabulary(), tokenizer)
    every = {(r[1] or "").replace("▁", " ") for r in rows}
    assert new.count() == new.select("digest").distinct().count() == len(every) - before
    check_counts(counting.count_tokens(docs, cache), rows)
    assert counting.stored(spark, cache, tokenizer).count() == len(every)
    check_counts(counting.count_tokens(docs, cache), rows)  # all are stored
    assert counting.stored(spark, cache, tokenizer).count() == len(every)


def test_stored_counts_are_used_and_may_stand_twice(spark, cache):
    tokenizer = counting.version(counting.default_vocabulary())
    digest = hashlib.sha256(b"told apart").digest()
    two = spark.createDataFrame([(digest, 77, tokenizer), (digest, 77, tokenizer), (digest, 5, "another tokenizer")], "digest binary, n_tokens long, tokenizer string")
    two.write.partitionBy("tokenizer").parquet(cache)
    got = counting.count_tokens(table(spark, [(1, "told apart", None, None), (2, "told▁apart", None, None)]), cache)
    assert sorted(map(tuple, got.collect())) == [(1, 10, 77, False), (2, 12, 77, False)]


def test_a_task_that_forgets_digests_sends_texts_again_but_encodes_once(spark, rows, cache, monkeypatch):
    monkeypatch.setattr(counting, "SEEN", 2)
    check_counts(counting.count_tokens(table(spark, rows).coalesce(1), cache), rows)
    assert counting.stored(spark, cache, counting.version(counting.default_vocabulary())).count() == len({r[1] or "" for r in rows})


def test_json_tokenizers_count_too(spark, cache):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", "some words, and more", "a▁b", "<|endoftext|>"]
    got = counting.count_tokens(table(spark, [(i, t, None, None) for i, t in enumerate(texts)]), cache, path)
    library = Tokenizer.from_file(path)
    assert [r.n_tokens for r in sorted(got.collect())] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_another_tokenizer_on_a_worker_is_an_error(spark, cache):
    with pytest.raises(ValueError, match="driver's is"):
        counting.worker_counter(counting.default_vocabulary(), "other")


def test_counts_of_nothing(spark, cache):
    assert counting.count_tokens(table(spark, []), cache).count() == 0


# --- resampling ------------------------------------------------------------------------------


def runs(text, n):
    words = re.findall(WORD, lower(text))
    return words, [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def brute_resample(rows, target, n=1, buckets=10_000, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    features = [runs(r[1], n) for r in rows]
    s, t = Counter(bucket(f) for _, fs in features for f in fs), Counter(bucket(f) for x in target for f in runs(x, n)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for r, (words, fs) in zip(rows, features, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([r[0], len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: len(able) * percent // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in out]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (2, 500), (3, 97), (4, 10_000)])
def test_resampling_is_brute_force(spark, rows, n, buckets):
    target = ["Beta zeta wax, wby wcz", None, "alpha alpha beta 12 theta_x", ""]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, item_id long")
    got = resampling.resample(table(spark, rows).repartition(4), wanted, longest=n, buckets=buckets)
    same(got, brute_resample(rows, target, n, buckets))


def test_ties_go_to_the_smaller_id_and_copies_spread(spark):
    rows = [(i % 7, "same words here " * 10, "en", "a") for i in range(70)]
    wanted = spark.createDataFrame([("same",)], "text string")
    same(resampling.resample(table(spark, rows).repartition(9), wanted), brute_resample(rows, ["same"]))


def test_resampling_without_target_or_documents(spark, rows):
    none = spark.createDataFrame([], "text string")
    same(resampling.resample(table(spark, rows), none), brute_resample(rows, []))
    assert resampling.resample(table(spark, []), none).count() == 0


def test_run_hashes_are_those_of_joined_words():
    words = [b"a", b"bc", b"", b"d", b"a", b"a"]
    for n in range(1, 8):
        assert sorted(resampling.run_hashes(words, n)) == sorted(zlib.crc32(b" ".join(words[i : i + k])) for i in range(6) for k in range(1, n + 1) if i + k <= 6)
