"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import random

import numpy as np
import public_tokenizers
import pytest

from trekframe.llm import decontaminate, embedding_dedup, jaccard_join, license_scan, packing, quality, suffix_dedup, token_counts, toxicity
from trekframe.llm.decontaminate import edit_match, find_leaks, max_edits
from trekframe.llm.embedding_dedup import embedding_links

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"w{i}" for i in range(500)]
CLASH = "doc_id long, text string, lang string, score double, quality_score double, toxicity_score double, spans int, rest int, gone int, key int, n_links int, component int, words int, sections int, piece int, length int"


def rows_of(texts):
    return [(i, t, "en", *[1.0] * 3, *range(10)) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice(WORDS) for _ in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one word"), (4, "one word"), (None, "no id at all"), (None, None), (5, long), (6, long), (7, long[:200_000])]
    return spark.createDataFrame(rows_of(texts), CLASH).repartition(3)


def test_every_operator_gives_each_row_once(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    n = odd.count()
    for out in (quality.quality_scores(odd, labels), toxicity.toxicity_scores(odd, labels), license_scan.scan_licenses(odd), jaccard_join.jaccard_links(odd), suffix_dedup.repeat_report(odd)):
        assert out.count() == n
    assert quality.score_quality(odd, quality.fit([], [])).columns == odd.columns
    counted = token_counts.section_token_counts(odd, PATH).groupBy("doc_id").count().collect()
    assert len(counted) == 8  # all ids, and null
    pieces = packing.pack_documents(odd, PATH)
    assert pieces.where("piece = 0").count() == n


def test_filters_keep_all_columns(spark, odd):
    bench = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    for out in (jaccard_join.drop_near_duplicates(odd), suffix_dedup.drop_repeats(odd), decontaminate.drop_contaminated(odd, bench)):
        assert out.columns == odd.columns
        assert out.where("doc_id is null").count() == 2 and out.where("doc_id = 1 and text is null").count() == 1
        assert out.where("spans = 3 and rest = 4 and quality_score = 1.0").count() == 0
        assert out.where("spans = 0 and rest = 1 and quality_score = 1.0").count() == out.count()
    left = {r.doc_id: len(r.text or "") for r in suffix_dedup.drop_repeats(odd).where("doc_id > 4").collect()}
    assert 6 not in left and 7 not in left and left[5] > 100_000  # the copies of a very long text go


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    for out in (
        quality.quality_scores(none, labels), toxicity.toxicity_scores(none, labels), license_scan.scan_licenses(none), jaccard_join.jaccard_links(none), suffix_dedup.repeat_report(none),
        token_counts.section_token_counts(none, PATH), packing.pack_documents(none, PATH), find_leaks(none, some), find_leaks(odd, bench), suffix_dedup.drop_repeats(none),
        embedding_links(spark.createDataFrame([], "vec_id long, embedding array<double>")),
    ):
        assert out.count() == 0


def test_vectors_without_ids_and_repeated_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v), (1, v), (1, v), (2, [1.0, 2.0, 3.1]), (3, [-1.0, 0.0, 0.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs of cosine 0.95 to 0.96, many of them, among other vectors, some in a crowd: nearly all are found."""
    monkeypatch.setattr(embedding_dedup, "CROWD", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rng = np.random.default_rng(12)
    dim, n = 32, 1500
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a = unit(rng.normal(size=(n, dim)))
    side = rng.normal(size=(n, dim))
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    cosine = rng.uniform(0.9501, 0.96, n)[:, None]
    crowd = unit(unit(rng.normal(size=dim)) + rng.normal(size=(150, dim)) * 0.02)
    vectors = np.concatenate([a, a * cosine + side * np.sqrt(1 - cosine**2), crowd])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in embedding_links(frame).collect()}
    exact = vectors @ vectors.T >= 0.95
    np.fill_diagonal(exact, False)
    want = exact.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= want).all()
    assert found[: 2 * n].sum() >= 0.99 * want[: 2 * n].sum() and want[: 2 * n].sum() >= 2 * n
    assert (found[2 * n :] == want[2 * n :]).all() and found[2 * n :].min() >= 149
    assert {got[i].component_id for i in range(2 * n, 2 * n + 150)} == {2 * n}


def test_leaks_with_words_inserted_and_copies_side_by_side(spark):
    """Insertions only, several starts met, an item twice in one text, one behind another: the true distance each time."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate([20, 20, 27, 41])]
    docs = []
    for _ in range(120):
        k, words = items[rng.randrange(4)]
        copy = list(words)
        for _ in range(rng.randint(0, max_edits(len(words), 0.15))):
            copy.insert(rng.randint(1, len(copy) - 1), rng.choice(vocabulary))
        again = list(words) if rng.random() < 0.3 else []
        docs.append((k, text(rng.randint(0, 6)) + copy + again + text(rng.randint(0, 6))))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, (_, w) in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(frame, bench, recall=0.9999).collect()}
    want = {}
    for i, (_, words) in enumerate(docs):
        for k, item in items:
            distance = edit_match(item, words)[0]
            if distance <= max_edits(len(item), 0.15):
                want[i, k] = distance
    assert got == want and len(want) >= 120


def test_leaks_at_the_limit_are_met(spark):
    """Half of 2,000 texts hold an item with as many words replaced, deleted and inserted as allowed."""
    rng = random.Random(15)
    vocabulary = [f"u{i}" for i in range(6000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.choice([14, 20, 31, 52]))) for k in range(100)]
    docs = []
    for i in range(2000):
        words = text(rng.randint(0, 12))
        if i % 2:
            copy = list(items[i % 100][1])
            for _ in range(max_edits(len(copy), 0.15)):
                at, kind = rng.randrange(len(copy)), rng.randrange(3)
                copy[at : at + (kind != 0)] = [rng.choice(vocabulary)] if kind < 2 else []
            words += copy + text(rng.randint(0, 3))
        docs.append((i, " ".join(words)))
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"))
    met = {(r.doc_id, r.item_id) for r in found.collect()}
    want = {(i, i % 100) for i in range(1, 2000, 2)}
    assert met <= want and len(met) >= 0.99 * len(want)


def test_a_plan_that_cannot_be_reached_is_an_error():
    with pytest.raises(ValueError):
        decontaminate.repeats_for(40, 0.5, 1.0, trials=50, most=3)
