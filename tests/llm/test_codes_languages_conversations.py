"""Vector codes, language profiles and conversation repair against plain forms of the same rules."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from trekframe.llm import conversation_repair, language_id, vector_codes
from trekframe.llm.hot_groups import with_group_totals

SF = "/root/testdata/sf0.001"

# --- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    cuts = [(c.start, c.stop) for c in vector_codes.part_cuts(len(kept[0][2]), parts)]
    books = [[list(v[a:b]) for _, _, v in kept[:entries]] for a, b in cuts]

    def nearest(book, x):
        return min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            met = {}
            for _, _, v in kept:
                met.setdefault(nearest(books[p], v[a:b])[1], []).append(v[a:b])
            for k, xs in met.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, label, v in kept:
        best = [nearest(books[p], v[a:b]) for p, (a, b) in enumerate(cuts)]
        out.append([i, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), 2**63 - 1), label])
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    return sorted(((i, c, e, min(by_label[la], 2**63 - 1), sha) for i, c, e, la in out), key=repr)


def test_bounds_never_lose_the_nearest_entry():
    rng = np.random.default_rng(5)
    for width, scale in ((16, 200), (16, 3), (3, 50), (1, 9), (7, 1 << 40)):
        x, entries = (rng.normal(size=(n, width)).cumsum(axis=1) * scale for n in (400, 60))
        x, entries = np.floor(x).astype(np.int64), np.floor(entries).astype(np.int64)
        entries[7] = entries[3]
        x[:20] = entries[rng.integers(0, 60, 20)]
        want = [min((sum((int(p) - int(q)) ** 2 for p, q in zip(r, e)), k) for k, e in enumerate(entries)) for r in x]
        at, far, exact = vector_codes.Codebook(entries).nearest(x)
        assert [(int(d), int(k)) for d, k in zip(far, at)] == want
        if (width, scale) == (16, 200):
            assert exact < 0.5 * len(x) * len(entries)  # the bounds do rule entries out


def test_codes_against_plain_means(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(10)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(7, rows[7][1], 2), (3, [0.5] * 10, 1), (None, [0.1] * 10, 1), (900, None, 1), (901, [None] * 10, 1), (902, [float("nan")] * 10, 1), (903, [float("inf")] * 10, None)]
    rows += [(904, [0.25] * 9, 1), (905, [float(2**45)] * 10, 5), (906, [-(2.0**45)] * 10, 5)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    got = vector_codes.vector_codes(frame, entries=20)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows, entries=20)


def test_no_vectors_and_vectors_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    got = vector_codes.vector_codes(spark.createDataFrame([(1, [], "a"), (2, [], None)], schema)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    with pytest.raises(ValueError, match="hex"):
        vector_codes.vector_codes(spark.createDataFrame([], schema), entries=300)


def test_totals_of_more_groups_than_are_broadcast(spark):
    from pyspark.sql import functions as F

    rows = [(k if k else None, j) for k in range(400) for j in range(5 if k < 3 else 1 + k % 2)]
    got = with_group_totals(spark.createDataFrame(rows, "k int, j int"), ["k"], {"total": F.sum("j"), "n": F.count(F.lit(1))}, least=2).collect()
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        js = [j for kk, j in rows if kk == k]
        assert {(r.total, r.n) for r in got if r.k == k} == ({(sum(js), len(js))} if len(js) > 1 else {(None, None)})


# --- languages


def test_a_bundle_is_the_sum_of_its_trigrams():
    b = language_id.Bundles(size=64)
    text = "Ab²c é_x 漢字x1\tA " + "q" * 50
    runs = ["ab", "c", "é", "x", "漢字x", "a", "q" * 50]

    def trigram(t):
        x, y, z = (b.letter(ord(c)) for c in t)
        return x[0].astype(int) * y[1] * z[2]

    want = sum(trigram(f" {r} "[i : i + 3]) for r in runs for i in range(len(r)))
    (got,) = b.of_texts([text])
    assert np.array_equal(got, want) and list(b.of_texts(["12 ...", None, ""])) == [None, None, None]
    assert np.array_equal(np.roll(b.letter(97)[2], 2), b.letter(97)[0])


def test_long_texts_are_counted_whole(monkeypatch):
    text = "".join(random.Random(1).choices("abcdé .", k=5000))
    want = language_id.Bundles(size=32).counts(text)
    monkeypatch.setattr(language_id, "_PIECE", 7)
    small = language_id.Bundles(size=32, limit=40)
    got = small.counts(text)
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
    assert np.array_equal(next(small.of_texts([text])), next(language_id.Bundles(size=32).of_texts([text])))


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    got = {r.doc_id: r for r in language_id.predict_languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert set(got) == set(truth) and {i for i in got if got[i].held_out} == set(held) and len(held) > 200
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_profiles_do_not_see_held_out_rows(spark):
    rows = [(i, "aaa bbb" if i % 2 else "xyz zyx", "l1" if i % 2 else "l2") for i in range(40)]
    lie = [(i, t, "lie" if zlib.crc32(str(i).encode()) % 4 == 2 else la) for i, t, la in rows]
    told = [{r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_languages(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()} for x in (rows, lie)]
    assert told[0] == told[1] and told[0][1][0] == "l1" and told[0][2][0] == "l2"


def test_documents_without_letters_ids_or_languages(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred int"
    k = next(i for i in range(5, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(1, None, "en", "", 1), (2, "", "en", "", 1), (3, "123 -", None, "", 1), (4, "word", None, "", 1), (None, "more words", "de", "", 1), (k, "only words here", "en", "", 1), (k, "only words here", "en", "", 1)]
    got = language_id.predict_languages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (k, "en"), (k, "en")]
    assert language_id.predict_languages(spark.createDataFrame([], schema)).collect() == []
    alone = language_id.predict_languages(spark.createDataFrame([(1, "abc", None, "", 1)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]


# --- conversations


def plain_edits(initials, kinds):
    """All edits tried: no more than three insertions in a row can be of use."""
    n, best = len(kinds), None
    import re

    ok = re.compile(r"(s?(ua)+)?")
    for row_edits in itertools.product("DKR", repeat=n):
        if any(e != "D" and k in "BD" for e, k in zip(row_edits, kinds)):
            continue
        for holes in itertools.product(range(3), repeat=n + 1):
            audit, cost = "", 3 * sum(holes)
            for e, k, h in zip(row_edits, kinds, holes):
                audit += "I" * h + e
                cost += {"D": 4, "R": 3, "K": 0}[e] + (3 if k == "T" and e != "D" else 0)
            audit += "I" * holes[-1]
            if best and (cost, audit) >= best:
                continue
            roles, i = [], 0
            for e in audit:
                if e == "K":
                    roles.append([initials[i]])
                elif e in "RI":
                    roles.append(["u", "a"])
                i += e != "I"
            if any(ok.fullmatch("".join(r)) for r in itertools.product(*roles)):
                best = (cost, audit)
    return best


def test_the_search_finds_the_cheapest_edits():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randrange(0, 5)
        initials, kinds = "".join(rng.choices("suax", k=n)), "".join(rng.choices("GGGTBD", k=n))
        (got,) = conversation_repair.cheapest_edits(initials, kinds).values()
        assert got == plain_edits(initials, kinds), (initials, kinds)


def plain_repair(rows):
    by = {}
    for c, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        by.setdefault(c, []).extend([] if fault == 0 else [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1))
    out = []
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds, said = "", set()
        for _, role, text in own:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            kinds += "B" if not core else "D" if (role, text) in said else "G" if core[-1] in ".!?" else "T"
            said.add((role, text))
        initials, roles, texts = [r[1][:1] for r in own], [r[1] for r in own], [r[2] for r in own]
        turns = {t for t, _, _ in own if t is not None}
        (cost, audit), spoken = plain_dp(initials, kinds, roles, texts)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("B"), kinds.count("D"), kinds.count("T"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(spoken).encode()).hexdigest()))
    return sorted(out, key=repr)


def plain_dp(initials, kinds, roles, texts):
    """From the end to the beginning: the least (cost, audit) of what follows, by what the grammar has read."""
    nxt = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    due = {"0": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for q in "0sua":
                t = due[q]
                more = best[t] and (best[t][0] + 3, "I" + best[t][1], [f"{names[t]}:", *best[t][2]])
                best[q] = min((x for x in (best[q], more) if x), default=None)
        return best

    best = inserted({"0": (0, "", []), "s": None, "u": None, "a": (0, "", [])})
    for i in range(len(kinds) - 1, -1, -1):
        now = {}
        for q in "0sua":
            ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            if kinds[i] not in "BD":
                late = 3 if kinds[i] == "T" else 0
                if (q, initials[i]) in nxt:
                    b = best[nxt[q, initials[i]]]
                    ways.append((b[0] + late, "K" + b[1], [f"{roles[i]}:{texts[i]}", *b[2]]))
                b = best[due[q]]
                ways.append((b[0] + late + 3, "R" + b[1], [f"{names[due[q]]}:{texts[i]}", *b[2]]))
            now[q] = min(ways)
        best = inserted(now)
    return best["0"][:2], best["0"][2]


@pytest.mark.parametrize("part_rows", [256, 5, 1])
def test_conversations_in_whole_and_in_parts(spark, part_rows):
    rng = random.Random(17)
    say = ["Yes.", "No", "What?", "", " \t", "long text.\n", "Hm! ", "a..."]
    rows = [(c, t, rng.choice(["system"] if t == 0 else ["user", "assistant", "user", "tool"]), rng.choice(say) + (str(t) + "." if t % 2 else "")) for c in range(25) for t in range(rng.choice([1, 3, 8, 40]))]
    rows += [(99, t % 30, rng.choice(["user", "assistant"]), rng.choice(say)) for t in range(300)]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (100, None, "user", None), (100, None, "", "x."), (101, -5, "assistant", "Ü."), (101, 2**40, "user", "Z.")]
    rows += [(102, t, "user", "same.") for t in range(40)] + [(103, 1, "user", "once more.")] * 60 + [rows[0]]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kind string").repartition(3)
    got = conversation_repair.repair_conversations(frame, part_rows=part_rows)
    assert got.columns == conversation_repair.RESULT
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_repair(rows)


def test_conversations_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.repair_conversations(spark.createDataFrame([], schema)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    got = conversation_repair.repair_conversations(spark.createDataFrame([(gone, 1, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_long_text_and_text_keys(spark):
    rows = [("a", 1, "user", "x" * 3_000_000 + "?"), ("a", 2, "assistant", "y" * 2_000_000 + ".")]
    got = conversation_repair.repair_conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == plain_repair(rows)
