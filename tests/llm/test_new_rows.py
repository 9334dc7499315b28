"""Importance resampling, periodic runs and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import packing, resample, runs
from tidewell.llm.tokens import WordEncoder, tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_features(text, longest=1):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_importance(rows, target, percent=10, least=20, buckets=10_000, longest=1):
    s, t, each = Counter(), Counter(), []
    for _, text in rows:
        words, found = plain_features(text, longest)
        own = [zlib.crc32(x.encode()) % buckets for x in found]
        s.update(own)
        each.append((len(words), own))
    for text in target:
        t.update(zlib.crc32(x.encode()) % buckets for x in plain_features(text, longest)[1])
    whole, aim = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for (doc_id, _), (n_words, own) in zip(rows, each, strict=True):
        total = sum(math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * aim))) for b in own)
        weight = total // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0]) for r in out if r[1] >= least)
    rank = {doc_id: i + 1 for i, (_, doc_id) in enumerate(able[: len(able) * percent // 100])}
    return sorted((*r, rank.get(r[0])) for r in out)


@pytest.mark.parametrize("longest", [1, 2])
def test_importance(spark, docs, rows, longest):
    target = [rows[0][1], "w1 w2 W3", None, "", "Straße ünïcode", "x" * 40]
    found = resample.importance(docs.repartition(5), spark.createDataFrame([(x, 1) for x in target], "text string, score int"), percent=30, longest=longest)
    assert sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == plain_importance([(r[0], r[1]) for r in rows], target, 30, longest=longest)


def test_importance_of_odd_rows(spark, docs, no_docs):
    target = spark.createDataFrame([("w1 w2",)], "text string")
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text)] * 40 + [(7, text)] * 40 + [(8, text)] * 20 + [(9, None), (10, "one")]
    found = resample.importance(spark.createDataFrame(rows, "doc_id long, text string"), target, percent=50).collect()
    assert len(found) == len(rows)
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 51))
    drawn = [r for r in found if r.rank]
    assert min(r.score for r in drawn) >= max(r.score for r in found if not r.rank and r.n_words >= 20)
    assert [r["rank"] for r in found if r.doc_id in (9, 10)] == [None, None]
    assert resample.importance(no_docs, target).count() == 0
    assert resample.importance(docs, target.limit(0)).count() == docs.count()


def test_resampled_keeps_columns(spark, docs):
    target = docs.select("text").limit(3)
    kept = resample.resampled(docs, target, percent=20)
    assert kept.columns == docs.columns
    ranked = resample.importance(docs, target, percent=20).where("rank IS NOT NULL")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in ranked.select("doc_id").collect())


def plain_runs(x, least=12):
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 90), st.integers(1, 6), st.sampled_from([2, 5, 12, 13]))
def test_runs_of_random_words(seed, n, vocabulary, least):
    rng = random.Random(seed)
    x = [rng.randrange(vocabulary) for _ in range(n)]
    for _ in range(rng.randrange(4)):  # plant repeats
        if n > 4:
            a, p = rng.randrange(n), rng.randrange(1, 9)
            for i in range(a, min(n, a + rng.randrange(40))):
                x[i] = x[a + (i - a) % p]
    assert runs.maximal_runs(np.array(x, np.int64), least) == plain_runs(x, least)
    assert runs.document_runs([b"%d" % i for i in x], least) == plain_runs(x, least)


def test_runs_of_long_periods_and_nested_runs():
    rng = random.Random(4)
    part = [rng.randrange(5000) for _ in range(700)]
    texts = [part * 2 + part[:133], [0] * 3000, ([0] * 50 + [1]) * 20, part + [9999] + part, [0, 1] * 400 + [2] + [0, 1, 1] * 300, part[:300] * 2 + part[:5] + part[:400] * 2]
    for x in texts:
        assert runs.document_runs([b"%d" % i for i in x]) == plain_runs(x)


def plain_op12(doc_id, text):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    span = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *span, digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12(spark, rows, tmp_path):
    short = [(r[0], r[1] if len(r[1] or "") < 20_000 else r[1][:9000]) for r in rows] + [(i, f"a b\x0bc\x1cd {'e f g ' * (i % 9)}h") for i in range(1000, 1040)]
    spark.createDataFrame([(*r, 1) for r in short], "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    found = runs.op12(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_op12(*r) for r in short)


def test_collapsed_and_odd_rows(spark, docs, no_docs):
    rows = [(None, "a b c " * 6 + "end", "x"), (1, None, "x"), (1, "", "y"), (1, " lone  words ", "y"), (1, "zu " * 100_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    kept = runs.collapsed(frame)
    assert kept.columns == frame.columns
    assert sorted(tuple(r) for r in kept.select(F.coalesce("text", F.lit("-")), "runs").collect()) == [("", "y"), (" lone  words ", "y"), ("-", "x"), ("a b c end", "x"), ("zu", "z")]
    assert runs.runs(frame).where("doc_id IS NULL").first().runs[0].asDict() == {"start": 0, "length": 18, "period": 3}
    assert runs.runs(no_docs).count() == 0 and runs.collapsed(docs).count() == docs.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.sampled_from([32, 64]))
def test_layout_of_random_groups(sizes, window):
    rows = packing.laid_out(sizes, window)
    seen = {}
    for d, start, n, _, _ in rows.tolist():
        seen.setdefault(d, []).append((start, n))
    assert sorted(seen) == list(range(len(sizes)))
    for d, own in seen.items():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), [*sorted(own)[1:], (sizes[d], 0)], strict=True)) and min(own)[0] == 0
    filled = {}
    for _, _, n, sequence, offset in rows.tolist():
        filled.setdefault(sequence, []).append((offset, n))
    for own in filled.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and min(own)[0] == 0
        total = sum(n for _, n in own)
        assert total <= window and (total == window or total & (total - 1) == 0)


def plain_differencing(sizes, windows):
    """Whole tuples, the way the method is written down."""
    parts = [[s] + [0] * (windows - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: min(p) - max(p))
        a, b = sorted(parts[0], reverse=True), sorted(parts[1])
        parts = [[x + y for x, y in zip(a, b, strict=True)], *parts[2:]]
    return max(parts[0]) - min(parts[0]) if parts else 0


def test_differencing_is_near_equal():
    rng = random.Random(5)
    for windows in (2, 3, 7):
        for _ in range(30):
            sizes = [rng.randrange(1, 500) for _ in range(rng.randrange(1, 40))]
            found = packing.differenced(sizes, windows)
            assert sorted(i for own in found for i in own) == list(range(len(sizes))) and len(found) == windows
            sums = [sum(sizes[i] for i in own) for own in found]
            assert max(sums) - min(sums) <= max(sizes)
            if len(sizes) > 6 * windows:
                assert max(sums) - min(sums) <= max(20, 2 * plain_differencing(sizes, windows))
    assert sorted(sorted(x) for x in packing.differenced([8, 7, 6, 5, 4], 2)) in ([[0, 1], [2, 3, 4]], [[0, 2], [1, 3, 4]], [[0, 3], [1, 2, 4]], [[0, 4], [1, 2, 3]])
    exact = packing.near_equal([60, 60, 60, 40, 40, 40], 100)
    assert [sum([60, 60, 60, 40, 40, 40][i] for i in own) for own in exact] == [100] * 3
    assert len(packing.near_equal([51, 51, 51], 100)) == 3  # the count rises


def check_packing(found, texts, window):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == sorted(texts)
    for doc_id, own in by_doc.items():
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        own.sort(key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and {r.doc_tokens for r in own} == {len(ids)}
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert total <= window and (total == window or total & (total - 1) == 0)


def test_packed(docs, rows):
    check_packing(packing.packed(docs.repartition(3), window=256, group_tokens=5000).collect(), {r[0]: r[1] for r in rows}, 256)


def test_op13_on_given_rows(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_packing(packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), texts, 4096)
    crc = packing.op13(spark, sf_dir).join(packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet")), ["doc_id", "start"])
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in crc.collect())


def test_packing_odd_rows(spark, no_docs):
    frame = spark.createDataFrame([(None, None, 1), (None, "a b", 2), (3, "", 3), (3, "b", 4)], "doc_id long, text string, ids int")
    found = packing.packed(frame.coalesce(1)).collect()
    assert sum(r.length for r in found) == 1 + 3 + 1 + 2
    assert packing.packed(no_docs).count() == 0


def test_word_encoder_gives_what_the_library_gives():
    own = WordEncoder(tokenizer_path(packing.TOKENIZER))
    assert own.by_word
    rng = random.Random(11)
    bits = ["The", "cat's", " ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "É", "é", "́", "ΣΑΣ", "42", "3.14", "don't", "'s", "日本語", "🙂", "<|endoftext|>", "<|endof", "!!", "İ", "가", "﻿", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(3000)] + ["", None, " \n ", "a" * 3000]
    want = [own.library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == want
    long = " ".join(rng.choice(bits[:4] + ["word", "Long"]) for _ in range(900_000))
    assert np.frombuffer(own.encode(long), "<u4").tolist() == own.library.encode(long, add_special_tokens=False).ids
