import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trekframe.llm.decontaminate import edit_match, find_leaks, length_class, max_edits, walk_keys, window_starts
from trekframe.llm.embedding_dedup import collision_plan, embedding_links
from trekframe.llm.jaccard_join import band_plan, drop_near_duplicates, jaccard_links, linked_pairs
from trekframe.llm import jaccard_join

WORDS = [f"w{i}" for i in range(3000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def grams(t):
    w = (t or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    out = [None, "", "  ", "One two", "one TWO", "a b c d e", "x"]
    for _ in range(12):
        base = text(rng, rng.choice([30, 120, 400]))
        out += [base] + [edited(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(0, 5))]
    hot = text(rng, 150)
    out += [edited(rng, hot, rng.randint(0, 3)) for _ in range(150)]
    return out


def test_jaccard_against_all_pairs(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, class_key string")
    got = {r.doc_id: r for r in jaccard_links(docs).collect()}
    sets = [grams(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    low = components(range(len(texts)), links)
    for i in range(len(texts)):
        assert got[i].n_links == sum(i in p for p in links), i
        assert got[i].component_id == low[i] and got[i].kept == (low[i] == i)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in low if low[i] == i}


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_links, r.component_id or 0, r.kept) for r in jaccard_links(docs).collect())
    assert len(got) == 5 and (5, 0, 5, True) in got and got.count((1, 2, 1, True)) == 2
    assert jaccard_links(docs.limit(0)).count() == 0


def test_blocks_of_many_pairs_equal_single_ones():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(200) < 0.08, rng.integers(0, 1 << 60, 200, dtype=np.uint64), base)) for _ in range(60)]
    got = {tuple(p) for p in linked_pairs(sets, sets, 0.8, True).tolist()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert got == want and 0 < len(want) < 1770


def test_plans():
    bands, rows = band_plan(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    for n in (100, 50_000, 10**9):
        bits, tables, count = collision_plan(n, 0.95, 0.998)
        assert count >= 3 and tables < 400


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=16) for _ in range(60)]
    for k in range(20):
        rows += [rows[k] + rng.normal(size=16) * s for s in (0.02, 0.05, 0.2)]
    rows += [rows[0] * 3, rows[0].copy(), np.zeros(16), np.full(16, np.nan), rng.normal(size=8)]
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(rows)] + [(900, None, 1), (901, [1.0, None], 1), (902, [], 1)]
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links int"), recall=0.9999).collect()}
    ok = [i for i, v in enumerate(rows) if len(v) == 16 and np.isfinite(v).all() and np.abs(v).sum() > 0]
    unit = {i: rows[i] / np.linalg.norm(rows[i]) for i in ok}
    links = [(a, b) for a in ok for b in ok if b < a and unit[a] @ unit[b] >= 0.95]
    low = components([*range(len(rows)), 900, 901, 902], links)
    for i, c in low.items():
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in links), c, c == i), i
    assert len(links) > 30


def test_leaks_against_all_pairs(spark):
    rng = random.Random(8)
    items = [(k, text(rng, n)) for k, n in enumerate([15, 18, 25, 33, 40, 59, 3])] + [(90, ""), (91, None)]
    docs = []
    for i in range(60):
        parts = [text(rng, rng.randint(5, 80))]
        if i % 3 == 0:
            _, t = items[(i // 3) % 7]
            parts += [edited(rng, t, rng.randint(0, max_edits(len(t.split()), 0.15))).upper(), text(rng, 10)]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (None, items[0][1])]
    frame = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for k, item in items:
            w = (item or "").lower().split()
            if d is not None and t and w:
                best = edit_match(w, t.lower().split())[0]
                if best <= max_edits(len(w), 0.15):
                    want[d, k] = best
    assert got == want and len(want) >= 20


def test_leaks_with_words_deleted_at_the_end_of_a_document(spark):
    rng = random.Random(11)
    items = [(k, text(rng, n)) for k, n in enumerate([7, 16, 20, 20, 39, 40, 59])]
    docs = []
    for k, t in items:
        for cut in range(max_edits(len(t.split()), 0.15) + 1):
            w = t.split()
            for _ in range(cut):
                w.pop(rng.randrange(len(w)))
            for before in (0, 1, 40):
                docs += [(len(docs), " ".join([text(rng, before), *w]), k, cut)]
    docs += [(len(docs), "", None, None)]
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").coalesce(2)
    found = find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), recall=0.9999).collect()
    words = [t.split() for _, t, _, _ in docs]
    assert {(r.doc_id, r.item_id) for r in found} == {(d, k) for d, _, k, _ in docs if k is not None}
    for r in found:
        assert r.distance == edit_match(items[r.item_id][1].split(), words[r.doc_id])[0] <= docs[r.doc_id][3]
        assert 0 <= r.first_word <= r.last_word < len(words[r.doc_id])


def test_edit_match_and_walks():
    assert edit_match("a b c".split(), "x a c y".split()) == (1, 1, 2)
    assert edit_match("a b c".split(), "x a b c y".split()) == (0, 1, 3)
    x = np.arange(100, 160, dtype=np.uint64)
    shifted = np.concatenate((np.array([7, 8], dtype=np.uint64), x))
    assert (walk_keys(x, np.array([0]), 30, 3) == walk_keys(shifted, np.array([2]), 30, 3)).all()
    assert [length_class(n) for n in (5, 20, 21, 40)] == [5, 20, 21, 40] and length_class(59) <= 59


def test_window_starts_against_all():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, size, least = int(rng.integers(1, 40)), int(rng.integers(1, 12)), int(rng.integers(0, 5))
        places = np.flatnonzero(rng.random(n) < 0.3)
        want = [s for s in range(n - size + 1) if ((places >= s) & (places < s + size)).sum() >= least]
        assert window_starts(places, n, size, least).tolist() == want


def test_large_groups_are_cut_into_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [grams(t) for t in texts]
    got = {r.doc_id: r.n_links for r in jaccard_links(docs).collect()}
    for i in range(0, len(texts), 9):
        assert got[i] == sum(j != i and bool(s) and bool(sets[i]) and len(s & sets[i]) >= 0.8 * len(s | sets[i]) - 1e-9 for j, s in enumerate(sets))


def test_each_pair_of_a_bucket_meets_in_one_unit(spark, monkeypatch):
    """Random band keys with crowds, hubs and equal buckets: a pair with a common key is compared once, others never."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(5)
    rows = [(i, [1000 * band + rng.choice([0, rng.randrange(6), 100 + i]) for band in range(6)]) for i in range(90)]
    rows += [(200 + i, [9000 + band for band in range(4)] + [9004 + i % 3, 5000 + rng.randrange(9)]) for i in range(40)]
    bands = dict(rows)
    units = jaccard_join.comparison_units(spark.createDataFrame(rows, "class_id long, bands array<long>"))
    spread = units.withColumn("other", F.explode(jaccard_join.blocks_to_meet())).collect()
    tasks = {}
    for r in spread:
        tasks.setdefault((r.band, r.key, *sorted((r.own, r.other))), []).append(r)
    seen = []
    for (band, _, i, j), own in tasks.items():
        left, right = [[r for r in own if r.own == side] for side in (i, j)]
        for a in left:
            for b in right:
                if (i != j or a.class_id < b.class_id) and (band < 0 or a.crowd != b.crowd):
                    common = [k for k, (x, y) in enumerate(zip(bands[a.class_id], bands[b.class_id])) if x == y]
                    if common and band in (-1, common[0]):
                        seen.append(tuple(sorted((a.class_id, b.class_id))))
    want = {(a, b) for a in bands for b in bands if a < b and any(x == y for x, y in zip(bands[a], bands[b]))}
    assert len(seen) == len(set(seen)) and set(seen) == want


def test_chained_chance_hits_stay_linear(spark):
    """50,000 classes in one chain of chance hits: one component, but each class is in two units of two."""
    n = 50_000
    link = lambda i: F.xxhash64(i, F.lit("link"))
    slot = [link(F.floor(F.col("id") / 2)), link(-F.floor((F.col("id") + 1) / 2) - 1)]
    chain = spark.range(n).select(F.col("id").alias("class_id"), F.array(*slot, *[F.xxhash64("id", F.lit(b)) for b in range(5)]).alias("bands"))
    got = jaccard_join.comparison_units(chain).agg(F.count("*").alias("rows"), F.max("blocks").alias("blocks"), F.countDistinct("key").alias("units")).first()
    assert got.rows <= 2 * n and got.blocks == 1 and got.units == n - 1


def test_repetitions_hold_on_fresh_edits_of_the_longest_item():
    """Windows of classes whose longest item may have one edit more than their size: the stated recall, on new trials."""
    from trekframe.llm.decontaminate import edited_windows, length_class, max_edits, repeats_for, walk_keys

    for words in (47, 67, 80, 40):
        size, trials = length_class(words), 3000
        repeats = repeats_for(size, 0.15, 0.99, longest=words)
        a, b = edited_windows(size, max_edits(words, 0.15), trials, seed=12345 + words)
        starts, met = np.arange(trials, dtype=np.int64) * size, np.zeros(trials, dtype=bool)
        for repeat in range(repeats):
            met |= walk_keys(a, starts, size, repeat) == walk_keys(b, starts, size, repeat)
        assert met.mean() >= 0.986, (words, size, repeats, met.mean())
