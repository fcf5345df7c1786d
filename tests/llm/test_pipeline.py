"""The pipeline end to end against a plain chain of the same stages on the smallest tables."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from trekframe.llm import quality
from trekframe.llm.decontaminate import edit_match, max_edits

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def good(rows, labels):
    """Scores of a model fitted on the labelled rows outside the held-out third, in the order of their ids."""
    known = {r.doc_id: r.quality for r in labels if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    own = sorted((i, t) for i, t in rows.items() if i in known)
    ngrams = quality.TextNgrams()
    model = quality.fit([ngrams.features(t) for _, t in own], np.array([known[i] for i, _ in own]))
    model.weights = model.weights.astype(np.float32)
    return {i: t for i, t in rows.items() if model.score(ngrams.features(t)) >= 0.5}


def one_of_each(rows):
    def grams(t):
        w = (t or "").lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: grams(t) for i, t in rows.items()}
    low = {i: i for i in rows}
    ids = sorted(rows)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    return {i: t for i, t in rows.items() if low[i] == i}


def without_repeats(rows, least=100):
    seen, out = set(), {}
    for i in sorted(rows):
        raw = (rows[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - least + 1):
            w = raw[s : s + least]
            if w in seen:
                gone[s : s + least] = True
            seen.add(w)
        left = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", errors="ignore")
        if left or not raw:
            out[i] = left if rows[i] is not None else None
    return out


def without_items(rows, items):
    out = {}
    for i, t in rows.items():
        words = (t or "").lower().split()
        held = set(words)
        for item in items:
            k = max_edits(len(item), 0.15)
            if sum(w in held for w in item) >= len(item) - k and edit_match(item, words)[0] <= k:
                break
        else:
            out[i] = t
    return out


def test_run_against_a_plain_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len({r.doc_id for r in docs}) == len(docs)
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := (r.text or "").lower().split())]
    rows = good({r.doc_id: r.text for r in docs}, spark.read.parquet(f"{SF}/labels.parquet").collect())
    kept = len(rows)
    rows = without_items(without_repeats(one_of_each(rows)), items)
    assert 0 < len(rows) < kept < len(docs)
    tokenizer = Tokenizer.from_file(PATH)
    want = set()
    for i, t in rows.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.add((i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= total / 2048 * 1.05 + 8
