import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from trekframe.llm import license_scan, suffix_dedup
from trekframe.llm.quality import quality_scores
from trekframe.llm.toxicity import language_thresholds, toxicity_scores


def brute_removed(texts, least):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - least + 1):
            w = raw[s : s + least]
            if w in seen:
                gone[s : s + least] = True
            seen.add(w)
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(3)]
    texts = {0: None, 1: "", 2: "short"}
    for i in range(3, 60):
        t = [" ".join(word() for _ in range(rng.randint(1, 60)))]
        if i % 2:
            t.insert(rng.randint(0, 1), passage[i % 3])
        if i % 7 == 0:
            t.append("ab " * rng.randint(20, 80))
        texts[i] = " ".join(t)
    texts[60], texts[61] = texts[5], texts[5][:-1]
    base = passage[0] + passage[1]
    for i in range(62, 90):
        k = rng.randrange(len(base))
        texts[i] = base[:k] + "#" + base[k + 1 :]
    return texts


@pytest.mark.parametrize("group", [512, 3])
def test_repeats_against_brute_force(spark, repeats, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    docs = spark.createDataFrame([(i, t, 1) for i, t in repeats.items()], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_report(docs).collect()}
    assert got == brute_removed(repeats, 100)


def test_very_long_texts_are_cut_without_a_seam(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 700)
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    texts = {1: t, 2: t[5_000:17_000] + "x" + t[5_500:5_700], 3: t[29_000:] + t[:300]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_report(docs).collect()} == brute_removed(texts, 100)


def test_drop_repeats(spark, repeats):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in repeats.items()], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in suffix_dedup.drop_repeats(docs).collect()}
    want = brute_removed(repeats, 100)
    assert set(out) == {i for i, (n, gone, _, _) in want.items() if n == 0 or gone < n}
    assert out[0].text is None and out[3].n_chars == len(out[3].text)


def test_lcp_intervals_cover_all_prefix_groups():
    rng = random.Random(0)
    for _ in range(50):
        words = sorted("".join(rng.choice("ab") for _ in range(6)) for _ in range(8))
        lcp = [next((k for k in range(6) if a[k] != b[k]), 6) for a, b in zip(words, words[1:])] + [0]
        got = {(d, tuple(range(a, b + 1))) for d, a, b in suffix_dedup.lcp_intervals(lcp, 0, 7)}
        want = set()
        for a in range(8):
            for b in range(a + 1, 8):
                d = min(lcp[a:b])
                if (a == 0 or lcp[a - 1] < d) and (b == 7 or lcp[b] < d):
                    want.add((d, tuple(range(a, b + 1))))
        assert got == want


def test_license_scan(spark):
    texts = [None, "", "Released under the MIT License.", "UNDER THE MIT LICENSE under the mit license", "Licensed under CC BY-NC 4.0.", "Apache License, Version 2.0; cc-by-nc",
             "the mit", "Permission is hereby granted, free of charge, to any person obtaining copies of this software and associated documentation files (the Software), to deal in the Software without restriction", "é under the mit licenseé"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x"), (None, texts[2], "x")], "doc_id long, text string, words string")
    rows = license_scan.scan_licenses(docs).collect()
    assert len(rows) == len(texts) + 2 and sum(r.doc_id == 2 for r in rows) == 2
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if places:
            assert r.score == 1
    assert "mit" in got[7].labels and got[7].n_base == 0 and got[6].labels == ""
    notice = license_scan.NOTICES[2][0]
    rows = [(k, phrase * n) for k, (phrase, n) in enumerate([("cc by nc ", 3), ("under the mit license ", 9), (notice + " ", 4), (" ".join(notice.split()[:9] + ["or"] + notice.split()[9:]) + " ", 2), ("cc by nc so cc by ", 5)])]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[k].n_base, got[k].labels, got[k].score) for k in (0, 1, 2)] == [(3, "cc-by-nc", 1.0), (9, "mit", 1.0), (0, "bsd", 1.0)]
    assert got[3].labels == "bsd" and got[3].score > 0.8 and (got[4].n_base, got[4].score) == (5, 1.0)


def test_license_scan_cuts_words_out_of_hits_only(spark):
    """The join's key is the hash of a run of words, never the words; votes are counted in one aggregation."""
    docs = spark.createDataFrame([(1, "so under the mit license, mit license the"), (2, "apache license version"), (2, "apache license version")], "doc_id long, text string")
    found = license_scan.scan_licenses(docs)
    assert [(r.doc_id, r.n_base, r.first_word) for r in found.orderBy("doc_id").collect()] == [(1, 1, 1), (2, 0, None), (2, 0, None)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    (join,) = [line for line in plan.split("\n") if "HashJoin" in line]
    assert "slice(" not in join and plan.count("HashAggregate(") == 4


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(1200):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            words.insert(rng.randrange(len(words)), "zzbad" + rng.choice("xyzuvw"))
        if not good:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), rng.choice(["en", "fr"]), i))
        labels.append((i, good, toxic))
    docs += [(5000, None, None, 0), (5001, "", "en", 0), (None, "some words", "en", 0), (7, "again", "en", 0)]
    labels += [(3, None, None), (None, 1, 1), (4, labels[4][1], labels[4][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("score, column, cut", [(quality_scores, 1, 0.5), (toxicity_scores, 2, 0.7)])
def test_classifiers_on_held_out_rows(labelled, score, column, cut):
    docs, labels, known = labelled
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {x[0]: x[column] for x in known if x[0] is not None and x[column] is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_classifiers_without_labels(labelled):
    docs, labels, _ = labelled
    few = docs.limit(20)
    for score in (quality_scores, toxicity_scores):
        assert score(few, labels.limit(0)).count() == 20
        assert score(docs.limit(0), labels.limit(0)).count() == 0


def test_thresholds_by_language():
    s = np.concatenate([np.linspace(0, 0.4, 50), np.linspace(0.6, 1, 50)])
    y = np.repeat([0, 1], 50)
    got = language_thresholds(s, y, ["en"] * 100)
    assert 0.4 < got["en"] <= 0.6 and language_thresholds(s[:10], y[:10], ["fr"] * 10) == {"fr": 0.7}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "benchmark", "packing"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids), name


def test_texts_are_cut_in_one_python_worker_a_task(spark, capsys):
    """The filter behind the cut must not bring a second run of it: each would hold a worker of its own beside the task."""
    docs = spark.createDataFrame([(1, "x" * 300), (2, "short"), (3, None), (4, "y" * 150 + "x" * 120)], "doc_id long, text string")
    out = suffix_dedup.drop_repeats(docs)
    out.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython [") == 1
    assert {r.doc_id: r.text for r in out.collect()} == {1: "x", 2: "short", 3: None, 4: "y"}
