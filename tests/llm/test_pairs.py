"""Near-duplicates, substring removal, decontamination and top-k against plain versions."""

import hashlib
import random
import re

import numpy as np
import xxhash

from tidewell.llm import decontaminate, simhash, substring, topk


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps, limit=4):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= limit
    label = np.array(ids)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_near_duplicates(docs, rows):
    found = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    ids, fps = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    assert found == sorted(zip(ids, fps, plain_components(ids, fps), strict=True))


def test_hot_buckets_are_cut_and_stay_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(150)})
    for block in (16, 50_000):
        edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block).distinct().collect()
        label = {f: f for f in fps}

        def root(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in edges:
            label[max(root(a), root(b))] = min(root(a), root(b))
        assert [root(f) for f in fps] == plain_components(fps, fps)


def test_deduplicated_keeps_smallest_and_columns(docs, rows):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids, fps = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(ids, fps)))


def plain_removal(rows, window=20):
    seen, out = {}, []
    for doc_id, text in sorted((r[0], r[1]) for r in rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if seen.setdefault(key, (doc_id, p)) != (doc_id, p):
                gone[p : p + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_removal(docs, rows):
    assert sorted(map(tuple, substring.remove_repeats(docs).collect())) == plain_removal(rows)
    with_text = substring.remove_repeats(docs, with_text=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in with_text)


def test_substring_removal_with_odd_ids(spark):
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    a, b = word(40), word(50)
    rows = [(7, f"{word(9)} {a}"), (7, f"{word(3)} {a} {word(30)} {b}"), (7, word(8)), (None, f"{b} x"), (None, f"y {b}"), (9, f"{a} {b}"), (9, f"{a} {b}"), (3, None), (3, word(90)), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key = {(r.doc_id, r.text): r.k for r in frame.selectExpr("doc_id", "text", "xxhash64(doc_id, doc_id IS NULL, text) AS k").collect()}
    place = lambda r: (r[0] is not None, r[0] or 0, key[r])
    first = {}
    for r in rows:
        words = (r[1] or "").split()
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            first[window] = min(first.get(window, (*place(r), p)), (*place(r), p))
    want = []
    for r in rows:
        words = (r[1] or "").split()
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            if first[tuple(words[p : p + 20])] != (*place(r), p):
                gone[p : p + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((r[0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(x) for x in substring.remove_repeats(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(x[2] for x in want) > 100


def test_near_duplicates_with_odd_ids(spark, docs, rows):
    text = "one two three four five six seven eight nine ten " * 3
    odd = [(None, text), (4, text), (2, text + "eleven twelve"), (None, "alone here"), (2, "another text of the same id"), (2, "another text of the same id")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id long, text string, gone_id string, mix_id int")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()]
    fps = [plain_fingerprint(t) for _, t in odd]
    labels = plain_components(list(range(len(odd))), fps)
    least = {label: min((i for (i, _), x in zip(odd, labels, strict=True) if x == label and i is not None), default=None) for label in labels}
    assert sorted(map(repr, got)) == sorted(repr((i, least[x])) for (i, _), x in zip(odd, labels, strict=True))
    kept = simhash.deduplicated(frame)
    assert kept.columns == frame.columns and kept.where("doc_id IS NULL").count() == 2 and sorted(r.text[:7] for r in kept.where("doc_id = 2").collect()) == ["another", "one two"]


def test_near_duplicates_link_through_rows_without_ids(spark):
    base = 0b1111
    edges = spark.createDataFrame([(0, base), (base, base << 4 | base)], "a long, b long")
    from tidewell.llm.common import connected_components

    assert {r.label for r in connected_components(edges).collect()} == {0}


def test_components_of_a_path_take_few_rounds(spark, monkeypatch):
    from tidewell.llm import common

    steps, plain = [], common.written
    monkeypatch.setattr(common, "written", lambda *a, **b: steps.append(a) or plain(*a, **b))
    n = 1000
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5000, 5001), (-3, 7000), (7000, 6000)], "a long, b long")
    labels = dict(common.connected_components(path).collect())
    assert labels == dict.fromkeys(range(n + 1), 0) | {5000: 5000, 5001: 5000, -3: -3, 7000: -3, 6000: -3}
    assert (len(steps) - 3) / 3 <= 15


def test_rows_that_share_an_id_are_told_apart_by_their_texts(spark):
    a, b = "one two three four five six seven eight nine ten " * 2, "quite another text that shares nothing with the first of them at all " * 2
    frame = spark.createDataFrame([(1, a, "x"), (5, a, "y"), (5, b, "z"), (None, b, "n")], "doc_id long, text string, source string")
    kept = simhash.deduplicated(frame)
    assert sorted(r.source for r in kept.collect()) == ["n", "x", "z"]
    from tidewell.llm import similar

    assert sorted(r.source for r in simhash.one_of_each(frame, similar.components).collect()) == ["n", "x", "z"]


def test_top_k_with_odd_ids(spark):
    rows = [(100, [float("nan"), 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [2.0, 0.0]), (1, [1.0, 2.0]), (None, [9.0, 9.0]), (2, [float("inf"), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(frame, frame.where("vec_id % 100 = 0")).collect()]
    assert sorted(got) == [(100, 1, 1, 3 * 1024 * 1024), (100, 1, 1, 2 * 1024 * 1024)][::-1]


def test_decontamination(spark, docs, rows):
    long = next(r for r in rows if r[1] and 60 < len(r[1].split()) < 120)
    words = long[1].split()
    moved = " ".join(words[30:50] + words[0:25])  # reordered
    broken = " ".join(words[:20] + ["other"] + words[21:45])
    items = [(1, " ".join(words[5:40])), (2, moved), (3, broken), (4, "nothing of this is there at all anywhere"), (5, None), (6, ""), (7, "one two"), (1, " ".join(words[5:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench).collect()
    assert {(r.item_id, r.tiles) for r in found if r.doc_id == long[0]} == {(1, 1), (2, 2), (3, 2)}
    assert all(r.coverage >= 0.8 for r in found)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {r.doc_id for r in found}


def plain_tiles(doc, item, k=5):
    """Greedy string tiling by trying every pair of places."""
    used, free, tiles = [False] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not used[d + n] and free[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < min(k, len(item)):
            return tiles
        used[d : d + n], free[i : i + n] = [True] * n, [False] * n
        tiles.append(best)


def test_decontamination_against_plain_tiling(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    word = lambda n, v: [f"w{x}" for x in rng.integers(0, v, n)]
    items = [word(int(n), 6) for n in rng.integers(1, 30, 40)] + [word(int(n), 300) for n in rng.integers(1, 30, 40)] + [["a"] * 12, ["a"]]
    docs = []
    for _ in range(60):
        own, parts = word(int(rng.integers(0, 30)), 6), []
        for item in rng.choice(len(items), 3):
            cut = int(rng.integers(0, len(items[item]) + 1))
            parts += [items[item][cut:], word(int(rng.integers(0, 4)), 300), items[item][:cut]]
        docs.append(own + [w for p in parts for w in p])
    docs += [["a"] * 30, []]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(None, " ".join(docs[0])), (0, " ".join(docs[1]))]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(3, " ".join(items[5])), (None, " ".join(items[0])), (99, None), (98, "!!")], "item_id long, text string")
    want = []
    for doc_id, text in rows:
        for item_id, item in [*enumerate(items), (3, items[5]), (None, items[0])]:
            tiles = plain_tiles(text.split(), item)
            covered = sum(n for n, _, _ in tiles)
            if covered >= 0.8 * len(item):
                want.append((doc_id, item_id, len(item), covered, len(tiles)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:5] for r in decontaminate.contamination(frame, bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 100
    pairs = {}
    for seeds in (50, decontaminate.SEEDS):  # small steps give the same
        monkeypatch.setattr(decontaminate, "SEEDS", seeds)
        block = decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items])
        pairs[seeds] = sorted((r, i, t) for r, i, t in block.contained(pa.array([" ".join(d) for d in docs], pa.large_string()), 0.8))
    assert len({repr(x) for x in pairs.values()}) == 1


def test_short_items_have_to_stand_whole(spark):
    docs = spark.createDataFrame([(1, "the capital of France is Paris"), (2, "the capital of a France"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "capital of france"), (2, "Paris?")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.tiles, r.coverage) for r in decontaminate.contamination(docs, bench).collect()) == [(1, 1, 1, 1.0), (1, 2, 1, 1.0)]


def test_tiling_takes_longest_first_and_never_overlaps():
    assert decontaminate.tile([(6, 0, 0), (6, 20, 5)], 11, 5) == [(6, 0, 0), (5, 21, 6)]
    assert decontaminate.tile([(5, 0, 0), (9, 40, 2)], 11, 5) == [(9, 40, 2)]


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in rng.normal(size=6).round(2)]) for i in range(300)]
    vectors += [(300 + i, [1.0] * 6) for i in range(40)] + [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, []), (404, [1.0, 2.0]), (7, [0.5] * 6)]
    frame = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<double>, score int, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, frame.where("vec_id % 20 = 0"), 5).collect())
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if v and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in usable:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in usable if i != q and len(y) == len(x)))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_top_k_scores_beyond_doubles_are_exact(spark):
    frame = spark.createDataFrame([(i, [1e6 + i, 3.0 * i, 1e6 - i]) for i in range(30)], "vec_id long, embedding array<double>")
    x = {i: [int(np.floor(1024 * v)) for v in (1e6 + i, 3.0 * i, 1e6 - i)] for i in range(30)}
    got = [(r.vec_id, r.score) for r in topk.top_k(frame, frame.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == sorted(((i, sum(a * b for a, b in zip(x[0], x[i], strict=True))) for i in range(1, 30)), key=lambda t: (-t[1], t[0]))[:5]


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(no_docs).count() == 0
    assert substring.remove_repeats(no_docs).count() == 0
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(vectors, vectors).count() == 0


def test_repeated_ids(spark, docs, rows):
    twice = docs.union(docs.limit(5))
    assert simhash.near_duplicates(twice).count() == len(rows) + 5
    assert simhash.deduplicated(twice).groupBy("doc_id").count().where("count > 1").count() == 0
    assert substring.remove_repeats(twice).count() == len(rows) + 5


def plain_similar(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)} - {()})
    near = np.array([[x == y or 5 * len(x & y) >= 4 * len(x | y) for y in sets] for x in sets])
    label = np.array([r[0] for r in rows])
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_pipeline_drops_near_copies_of_similarity_0_8(spark, docs, rows):
    import corpus_pipeline
    from tidewell.llm import similar

    rng = np.random.default_rng(11)
    planted = [(r[0], r[1]) for r in rows]
    for k in range(40):
        words = [f"v{x}" for x in rng.integers(0, 3000, int(rng.integers(40, 300)))]
        for j in range(4):
            edited = list(words)
            for at in rng.choice(len(words), int(rng.integers(0, max(2, len(words) // 35))), replace=False):
                edited[at] = f"e{at}"
            planted.append((1000 + 10 * k + j, " ".join(edited)))
    base = [f"u{x}" for x in rng.integers(0, 3000, 120)]
    for k in range(150):  # a large group
        planted.append((5000 + k, " ".join(base[:k % 90] + ["other"] + base[k % 90 + 1 :]) + f" t{k}"))
    planted.append((planted[5][0], "another text beside a doc_id that is taken"))
    frame = spark.createDataFrame(planted, "doc_id long, text string")
    want = plain_similar(planted)
    for size in (16, 10_000):
        got = sorted(map(tuple, similar.components(frame, bucket=size, group=size).collect()))
        assert got == sorted(zip([r[0] for r in planted], want, strict=True))
    kept = corpus_pipeline.drop_near_duplicates(spark, frame.where("doc_id >= 1000"), "")
    ids = [r[0] for r in planted]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w for i, w in zip(ids, want, strict=True) if i >= 1000})
    assert kept.count() < simhash.deduplicated(frame.where("doc_id >= 1000")).count()


def test_shingles_of_a_slice_are_its_own():
    import pyarrow as pa

    from tidewell.llm import similar

    texts = pa.array(["One two three four five six", None, "a b", "", "Straße two three four five Six seven"])
    whole = [x.tolist() for x in similar.shingle_sets(texts)]
    assert [len(x) for x in whole] == [2, 0, 1, 0, 3]
    assert [x.tolist() for x in similar.shingle_sets(texts.slice(2))] == whole[2:]


def test_memory_of_the_stage_does_not_follow_the_batch(spark):
    """Texts are hashed a small piece at a time, and batches are bounded by bytes while the stage runs."""
    import tracemalloc

    import pyarrow as pa

    from tidewell.llm import similar
    from tidewell.llm.common import BATCH_SETTING, small_batches

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 700)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    assert batch.nbytes > 7 << 20
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in similar._nodes(5)(iter([batch]))) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()

    def sizes(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.nbytes])], names=["n"])

    frame = spark.range(0, 300, 1, 1).selectExpr("repeat(cast(id as string), 50000) AS text").mapInArrow(sizes, "n long")
    before = spark.conf.get(BATCH_SETTING)
    with small_batches(spark, 1 << 20):
        within = [r.n for r in frame.select("n").collect()]
    assert len(within) > 20 and max(within) < 3 << 20
    assert spark.conf.get(BATCH_SETTING) == before


def test_pigeonring_of_the_stage_finds_all_within_its_limit(spark, monkeypatch):
    """Components of all pairs within NEAR of 128 bits, in whole and in cut buckets; the stage takes its classes from them."""
    from tidewell.llm import similar
    from tidewell.llm.common import connected_components

    rng = random.Random(4)
    fps = [rng.getrandbits(128) for _ in range(150)]
    for k, fp in enumerate(fps[:90]):
        for flips in (k % 14, similar.NEAR, similar.NEAR + 1):
            fps.append(fp ^ sum(1 << i for i in rng.sample(range(128), flips)))
    fps += [fps[0] ^ (1 << i) for i in range(60)] + [0, 1]
    fps = list(dict.fromkeys(fps))
    near = [[j for j, y in enumerate(fps) if (x ^ y).bit_count() <= similar.NEAR] for x in fps]
    want = list(range(len(fps)))
    while (new := [min(want[j] for j in n) for n in near]) != want:
        want = new
    signed = lambda v: (v & (1 << 64) - 1) - ((v & (1 << 63)) << 1)
    frame = spark.createDataFrame([(i, signed(x), signed(x >> 64)) for i, x in enumerate(fps)], "node long, f long, g long")
    for bucket in (16, 50_000):
        found = dict(map(tuple, connected_components(similar.ring_links(frame, bucket)).collect()))
        assert [found.get(i, i) for i in range(len(fps))] == want
    links = []
    monkeypatch.setattr(similar, "ring_links", lambda *a, plain=similar.ring_links: links.append(plain(*a)) or links[-1])
    text = " ".join(f"v{x}" for x in range(300))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "another text of a few words")], "doc_id long, text string")
    assert sorted(map(tuple, similar.components(docs).collect())) == [(1, 1), (2, 1), (3, 3)]
    assert [x.distinct().count() for x in links] == [1]
