"""Token counts of fields and sections, from one encoding of the whole document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.words import SpanEncoder, small_batches, span_encoder

COUNTS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"
RULES = ("start", "end", "majority")


def line_sections(text: str) -> list[tuple[int, int]]:
    """Character spans of a text's lines, each with its line end: they cover the text without gaps."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends))


def allocate(spans: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with sorted, disjoint sections: tokens given to each, and tokens each shares.

    A token is joined with every section that it overlaps. One that overlaps several is given to just one of them:
    that of its first character (``start``), of its last one (``end``), or of most of its characters (``majority``,
    the earlier one in a tie). An empty span counts where it stands. A token outside all sections is given to none.
    """
    n = len(sections)
    given, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not len(spans):
        return given, crossing
    lo, hi = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.searchsorted(sections[:, 1], lo, side="right")  # first section that ends after the token's start
    last = np.searchsorted(sections[:, 0], hi, side="left") - 1  # last one that begins before its end
    meets = first <= last
    first, last, lo, hi = first[meets], last[meets], lo[meets], hi[meets]
    target = first if rule == "start" else last.copy()
    many = np.flatnonzero(last > first)
    width = last[many] - first[many] + 1
    token = np.repeat(many, width)  # a row for each section that a crossing token meets
    section = np.repeat(first[many] - np.cumsum(width) + width, width) + np.arange(width.sum())
    if rule == "majority":
        target = first.copy()
        shared = np.minimum(sections[section, 1], hi[token]) - np.maximum(sections[section, 0], lo[token])
        order = np.lexsort((section, -shared, token))
        target[many] = section[order[np.cumsum(width) - width]]
    given += np.bincount(target, minlength=n)
    crossing += np.bincount(section, minlength=n)
    return given, crossing


def count_tokens(encoder: SpanEncoder, text: str, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``allocate`` gives for the tokens of a text, without a list of all their spans.

    Where no token crosses white space, the tokens of a word between two edges of sections are counted by number, and
    only those of words across an edge have their spans looked at. Texts whose words cannot be encoded one by one, or
    stand across edges for more than an eighth (and eight), have the spans of all their tokens joined with the sections.
    """
    found = encoder.words(text)
    if found is None:
        return allocate(encoder.of(text), sections, rule)
    words, lengths, counts = found
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    edges = sections.ravel()
    before = np.searchsorted(starts, edges) - 1  # the last word that starts before each edge
    across = sorted(set(before[(before >= 0) & (ends[before] > edges)].tolist()))
    if len(across) > 8 + len(words) // 8:
        return allocate(encoder.of(text), sections, rule)
    counts[across] = 0
    sums = np.concatenate(([0], np.cumsum(counts)))
    given = sums[np.searchsorted(ends, sections[:, 1], side="right")] - sums[np.searchsorted(starts, sections[:, 0])]
    spans = [(a + x, a + y) for k in across for a in (int(starts[k]),) for x, y in encoder.word_spans(words[k])]
    tokens, crossing = allocate(np.array(spans, dtype=np.int64).reshape(-1, 2), sections, rule)
    return given + tokens, crossing


def section_token_counts(
    docs: DataFrame, tokenizer_path: str, sections: str | None = None, rule: str = "majority", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Tokens of each section of each document.

    ``sections`` names a column of sorted, disjoint ``struct<start, end>`` character spans; without it the lines of
    the text are the sections. The whole text is encoded once, whatever its sections are (word by word where no token
    crosses white space, which gives the same tokens), and its token spans are joined with the sections; see
    ``allocate`` for tokens that cross a boundary. Returns a row for each section: ``n_tokens`` given to it and
    ``n_crossing`` of the tokens that it shares with another. A null text counts as empty, with one empty section; a
    null or empty list of sections gives no row. Repeated rows and null ids give rows of their own, texts of any length
    are encoded whole, other columns are ignored, and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")]
    if sections:
        spans = F.transform(sections, lambda s: F.array(s["start"].cast("long"), s["end"].cast("long")))
        columns.append(spans.alias("sections"))

    def count(batches):
        encoder = span_encoder(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            given_sections = batch.column(2).to_pylist() if sections else None
            out = []
            for k, (doc_id, text) in enumerate(zip(ids, texts)):
                text = text or ""
                own = line_sections(text) if given_sections is None else given_sections[k]
                if not own:
                    continue
                own = np.array(own, dtype=np.int64).reshape(-1, 2)
                tokens, crossing = count_tokens(encoder, text, own, rule)
                m = len(own)
                out.append((np.full(m, -1 if doc_id is None else doc_id, np.int64), np.full(m, doc_id is None), np.arange(m, dtype=np.int32), own[:, 0], own[:, 1], tokens, crossing))
            if not out:
                continue
            d, none, k, a, b, t, x = (np.concatenate(c) for c in zip(*out))
            arrays = [pa.array(d, mask=none), *(pa.array(c) for c in (k, a, b, t, x))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return docs.select(*columns).mapInArrow(count, COUNTS)


def block_sections(text: str = "text", size: int = 1000):
    """Column of consecutive sections of ``size`` characters that cover a text; an empty or null text has one empty one."""
    n = F.char_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))
