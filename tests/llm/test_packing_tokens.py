import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trekframe.llm.packing import OpenBins, pack_documents
from trekframe.llm.token_counts import allocate, block_sections, section_token_counts
from trekframe.llm.words import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, world!", "  a\tb\n\nÉté  naïve 中文 words'll ", "İstanbul ΣΑΣ é x y z \x1c q", "tail <|endoftext|> inside", "ab " * 3000, "same text", "same text", "\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string")


def test_word_encoder_equals_whole_encoding():
    tok = Tokenizer.from_file(PATH)
    ids = WordEncoder(PATH, limit=50)
    assert ids.by_word
    rng = random.Random(1)
    more = ["".join(rng.choice("aB é́\t\nßİ'sz1中 !? \x0b") for _ in range(200)) for _ in range(200)]
    for t in [x for x in TEXTS if x is not None] + more:
        e = tok.encode(t, add_special_tokens=False)
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == e.ids
    other = public_tokenizers.path("byte_bpe_50k.json")
    whole = WordEncoder(other)
    assert not whole.by_word and np.frombuffer(whole.ids("a  B\nc"), "<u4").tolist() == Tokenizer.from_file(other).encode("a  B\nc", add_special_tokens=False).ids


def test_packing(docs):
    tok = Tokenizer.from_file(PATH)
    got = pack_documents(docs, PATH, max_tokens=64, open_bins=3, partitions=2).collect()
    bins, by_doc = {}, {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 64
    assert set(by_doc) == {*range(len(TEXTS)), None}
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(p.piece, p.start) for p in pieces] == [(k, 64 * k) for k in range(-(-len(ids) // 64))]
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_packing_empty(docs):
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_open_bins_match_a_plain_search():
    rng = random.Random(3)
    bins, plain, nxt = OpenBins(100, 4, 0), {}, 0
    for _ in range(2000):
        n = rng.randint(1, 100)
        got, at = bins.place(n)
        fit = [f for f in plain.values() if f >= n]
        if fit:
            assert plain[got] == min(fit) and at == 100 - min(fit)
        else:
            assert got == nxt and at == 0
            plain[got], nxt = 100, nxt + 1
        plain[got] -= n
        if not plain[got]:
            del plain[got]
        if len(plain) > 4:
            del plain[_fullest(plain, bins)]
        assert sorted(plain.values()) == sorted(f for f, ids in enumerate(bins.bins) for _ in ids)


def _fullest(plain, bins):
    kept = {b for ids in bins.bins for b in ids}
    (gone,) = [b for b in plain if b not in kept]
    assert plain[gone] == min(plain.values())
    return gone


def _brute(spans, sections, rule):
    given, crossing = [0] * len(sections), [0] * len(sections)
    for a, b in spans:
        b = max(b, a + 1)
        share = [max(0, min(b, y) - max(a, x)) for x, y in sections]
        met = [k for k, s in enumerate(share) if s]
        if met:
            given[{"start": met[0], "end": met[-1], "majority": max(met, key=lambda k: (share[k], -k))}[rule]] += 1
        if len(met) > 1:
            for k in met:
                crossing[k] += 1
    return given, crossing


@pytest.mark.parametrize("rule", ["start", "end", "majority"])
def test_allocation_against_all_pairs(rule):
    rng = random.Random(5)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), 8))
        sections = [(cuts[k], cuts[k + 1]) for k in range(0, 8, 2)]
        at, spans = 0, []
        while at < 60:
            n = rng.randint(0, 9)
            spans.append((at, at + n))
            at += n + rng.randint(0, 3)
        given, crossing = allocate(np.array(spans), np.array(sections), rule)
        want = _brute(spans, sections, rule)
        assert (given.tolist(), crossing.tolist()) == want


def test_section_counts(docs):
    tok = Tokenizer.from_file(PATH)
    blocks = docs.withColumn("s", block_sections("text", 7))
    got = section_token_counts(blocks, PATH, sections="s").collect()
    for i, t in enumerate(TEXTS):
        t = t or ""
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        sections = [(k, min(k + 7, len(t))) for k in range(0, len(t), 7)] or [(0, 0)]
        assert [(r.start, r.end) for r in rows] == sections
        want = _brute(tok.encode(t, add_special_tokens=False).offsets, sections, "majority")
        assert ([r.n_tokens for r in rows], [r.n_crossing for r in rows]) == want
    lines = section_token_counts(docs, PATH).where("doc_id = 3").collect()
    assert len(lines) == 3


def test_packing_does_not_hang_on_the_session_and_equals_a_plain_packer(spark):
    """One partition for few tokens, whatever the shuffle partitions are, and the plain best fit over its pieces."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "ab " * rng.randint(0, 300)) for i in range(400)], "doc_id long, text string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(tuple(r) for r in pack_documents(docs, PATH, max_tokens=256).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert seen[0] == seen[1]
    free, placed = [], {}
    order = spark.createDataFrame([r[:5] for r in seen[0]], "doc_id long, piece int, start long, length long, ids_crc32 long").selectExpr("*", "xxhash64(piece, doc_id) as h").orderBy("h", "doc_id", "piece").collect()
    for r in order:
        fit = [(f, k) for k, f in enumerate(free) if f >= r.length]
        if fit:
            k = min(fit, key=lambda x: x[0])[1]
        else:
            free.append(256)
            k = len(free) - 1
        free[k] -= r.length
        placed[r.doc_id, r.piece] = k
    assert len({r[5] for r in seen[0]}) <= len(free) + 2
    assert sum(r[3] for r in seen[0]) <= 256 * len({r[5] for r in seen[0]}) <= 1.1 * sum(r[3] for r in seen[0]) + 512


def test_spans_of_plain_texts_are_those_of_the_tokenizer():
    """Texts that skip the normalizer and texts that may not: the same spans as from the tokenizer itself."""
    from trekframe.llm.words import SpanEncoder

    texts = [
        "", " ", "Plain TEXT,  two spaces\n\tand it's 12 tabs", "\u0418\u0306 \u0419 \u0416\u0423\u041a", "\u0130stanbul I\u0307 \u00c4\u00d6\u00dc \u00df \u1e9e",
        "\u03a3\u0399\u03a3 \u03a3", "A<|ENDOFTEXT|>B <|endoftext|> c", "cafe\u0301 CAF\u00c9 \u00a0\u2003\u0085 x\u200by", "\u4f60\u597d \U0001f600 Z\u0300", "\x00\x1f\x1c A", "L'\u00c9T\u00c9'S \u01c5 \u01c4 \u0149",
    ]
    for path in (PATH, public_tokenizers.path("byte_bpe_50k.json")):
        tok, encoder = Tokenizer.from_file(path), SpanEncoder(path)
        for text in [*texts, " ".join(texts), "".join(texts) * 50]:
            assert encoder.of(text).tolist() == [list(x) for x in tok.encode(text, add_special_tokens=False).offsets]
    plain, low = SpanEncoder(PATH), "".join(map(chr, [*range(0x300), *range(0x400, 0x483), *range(0x48A, 0x530)]))
    for c in low:
        text = f"a{c}B {c}{c}"
        assert plain.of(text).tolist() == [list(x) for x in plain.full.encode(text, add_special_tokens=False).offsets], hex(ord(c))


@pytest.mark.parametrize("rule", ["start", "end", "majority"])
def test_tokens_between_edges_are_counted_without_all_spans(rule):
    """The counts over all spans, from an encoding that shows the spans of single tokens only."""
    from trekframe.llm.token_counts import count_tokens
    from trekframe.llm.words import SpanEncoder

    class Single:
        def __init__(self, encoding):
            self.n, self.token_to_chars = len(encoding), encoding.token_to_chars

        def __len__(self):
            return self.n

    class Encoder(SpanEncoder):
        def encoded(self, text):
            encoding, ordered = super().encoded(text)
            return Single(encoding) if ordered else encoding, ordered

    rng = random.Random(11)
    encoder = Encoder(PATH)
    whole = SpanEncoder(PATH)
    for k in range(200):
        text = "".join(rng.choice("abcdefgh  étеҁӀԁ''\n12.!?-XYZ") for _ in range(rng.randint(200, 900))) + (" 中 " if k % 10 == 0 else "") * 40
        if k % 10:
            cuts = sorted(rng.sample(range(len(text) + 1), 8))
            sections = [(cuts[j], cuts[j + 1]) for j in range(0, 7, rng.choice((1, 2)))]
        else:
            sections = [(0, len(text) // 2), (len(text) // 2, len(text))]
        if k % 10 == 0:
            encoder = SpanEncoder(PATH)  # not the plain way: all spans
        got = count_tokens(encoder, text, np.array(sections), rule)
        encoder = Encoder(PATH) if k % 10 == 0 else encoder
        want = _brute(whole.of(text).tolist(), sections, rule)
        assert (got[0].tolist(), got[1].tolist()) == want


def test_spellings_of_a_word_are_encoded_once():
    """One memory of a word for all its spellings, with the ids of the whole tokenizer for every character and case."""
    tok, encoder = Tokenizer.from_file(PATH), WordEncoder(PATH)
    encoder.ids("Word WORD word\nwOrD Élan ÉLAN")
    assert set(encoder.words) == {"word", "élan"} == set(encoder.letters)
    low = "".join(map(chr, [*range(0x300), *range(0x400, 0x483), *range(0x48A, 0x530)]))
    texts = [f"a{c}B {c}{c} X{c}." for c in low] + [
        low, low.upper(), "A<|ENDOFTEXT|>B <|endoftext|> <|StartOfText|>", "X<|ENDOFTEXT|>", "İSTANBUL Word", "Й Й ΣΙΣ Σ Word", "L'ÉTÉ'S IT'LL Ǆ ŉ ẞ", "",
    ]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_a_process_keeps_its_encoder_until_the_file_changes(tmp_path):
    from trekframe.llm.words import word_encoder

    first = word_encoder(PATH)
    first.ids("remembered")
    assert word_encoder(PATH) is first and "remembered" in first.words
    path = tmp_path / "t.json"
    path.write_bytes(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    assert not word_encoder(str(path)).by_word
    path.write_bytes(open(PATH, "rb").read())
    os.utime(path, ns=(1, 1))
    assert word_encoder(str(path)).by_word


@pytest.mark.parametrize("rule", ["start", "end", "majority"])
def test_a_text_is_counted_from_words_met_before(rule):
    """The tokenizer sees only words across an edge, and the counts are those over all spans of the whole text."""
    from trekframe.llm.token_counts import count_tokens
    from trekframe.llm.words import SpanEncoder

    class Seen:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, []

        def encode(self, text, **options):
            self.texts.append(text)
            return self.tokenizer.encode(text, **options)

    encoder, whole, rng = SpanEncoder(PATH), SpanEncoder(PATH), random.Random(17)
    encoder.plain = seen = Seen(encoder.plain)
    for _ in range(200):
        text = "".join(rng.choice(["Word", "it's ", "'LL", " ", " ", "\n", "\x0b", " ", "ÉtÉ", "Жук ", "1984 ", "?!", "-- ", "internationalisation "]) for _ in range(300))
        cuts = sorted(rng.sample(range(len(text) + 20), 6))
        sections = [(cuts[j], cuts[j + 1]) for j in range(0, 5, rng.choice((1, 2)))]
        seen.texts.clear()
        got = count_tokens(encoder, text, np.array(sections), rule)
        assert (got[0].tolist(), got[1].tolist()) == _brute(whole.of(text).tolist(), sections, rule)
        assert len(seen.texts) <= 6 and not any(c in word for word in seen.texts for c in " \n")
