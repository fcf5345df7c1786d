"""Removal of repeated byte strings: a distributed, sparse enhanced suffix array and its interval tree.

Suffixes are taken only where the text itself says so: of every ``min_bytes`` consecutive bytes, the place of the least
hash of ``ANCHOR`` bytes. Equal strings of that length have such an anchor at the same place, so every repeat is seen at
an anchor. All suffixes that begin with one anchor's bytes form a part of the suffix array that can be sorted alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.words import mix, small_batches
from trekframe.storage import materialize

ANCHOR = 32  # bytes of an anchor
GROUP = 512  # suffixes of one anchor that a task sorts at once; larger groups are first split by their next bytes
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_POS = np.uint64((1 << 24) - 1)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * _CHUNK)
            inverse = pow(_BASE, -1, 1 << 64)
            one = np.ones(1, dtype=np.uint64)
            self.up = np.cumprod(np.concatenate((one, np.full(n, _BASE, dtype=np.uint64))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate((one, np.full(n, inverse, dtype=np.uint64))), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def find_anchors(data: np.ndarray, ends: np.ndarray, min_bytes: int):
    """Anchors of texts laid end to end; ``ends`` has each one's end.

    Returns for each anchor its place, its hash, and the hash of its fragment: all bytes that strings of ``min_bytes``
    around it can reach within its text, with their extent.
    """
    n = len(data)
    empty = np.empty(0, dtype=np.int64)
    if n < min_bytes:
        return empty, empty, empty
    up, down = _POWERS.upto(n + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)))
    grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    low = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    width, have = min_bytes - ANCHOR + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    lengths = np.diff(np.concatenate(([0], ends)))
    end_of = np.repeat(ends, lengths)
    at = np.arange(len(low))
    low = low[at + min_bytes <= end_of[: len(low)]]  # windows within one text
    place = (low & _POS).astype(np.int64)
    place = place[np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))] if len(place) else empty
    begin, stop = (ends - lengths)[np.searchsorted(ends, place, side="right")], end_of[place]
    a, b = np.maximum(begin, place - (min_bytes - ANCHOR)), np.minimum(stop, place + min_bytes)
    fragment = (sums[b] - sums[a]) * down[a]
    fragment = mix(fragment + mix(((place - a) * 1024 + (b - place)).astype(np.uint64)))
    return place, grams[place].view(np.int64), fragment.view(np.int64)


def _chunks(texts: list[bytes], min_bytes: int):
    """Texts in runs of about ``_CHUNK`` bytes: ``(index, offset of the part in its text, bytes)`` lists. A text that is
    much longer comes in parts that overlap so far that no string of ``min_bytes`` and its fragment are cut."""
    run, size = [], 0
    for k, t in enumerate(texts):
        step = 4 * _CHUNK
        if len(t) <= step:
            parts = [(k, 0, t)]
        else:
            margin = 2 * min_bytes
            parts = [(k, max(0, lo - margin), t[max(0, lo - margin) : lo + step + margin]) for lo in range(0, len(t), step)]
        for part in parts:
            run.append(part)
            size += len(part[2])
            if size >= _CHUNK:
                yield run
                run, size = [], 0
    if run:
        yield run


def anchors(docs: DataFrame, min_bytes: int) -> DataFrame:
    """``(hash, fragment, doc_id, pos)`` of every anchor."""

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            whole = np.array([len(t) for t in texts])
            for run in _chunks(texts, min_bytes):
                data = np.frombuffer(b"".join(p[2] for p in run), dtype=np.uint8)
                ends = np.cumsum([len(p[2]) for p in run])
                place, h, f = find_anchors(data, ends, min_bytes)
                part = np.searchsorted(ends, place, side="right")
                starts = np.concatenate(([0], ends[:-1]))
                owner, offset = np.array([p[0] for p in run])[part], np.array([p[1] for p in run])[part]
                local, size = place - starts[part], np.array([len(p[2]) for p in run])[part]
                # in a part of a long text, the anchors near an inner cut belong to its neighbour
                inner = (local >= np.where(offset > 0, min_bytes, 0)) & (local < np.where(offset + size < whole[owner], size - min_bytes, size))
                owner, pos, h, f = owner[inner], (local + offset)[inner], h[inner], f[inner]
                if len(pos):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(f), pa.array(np.array(ids)[owner]), pa.array(pos)], names=["hash", "fragment", "doc_id", "pos"])

    found = docs.mapInArrow(scan, "hash long, fragment long, doc_id long, pos long")
    return found


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _pad(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(-1, width)


def _common(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the rows of two padded byte matrices."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(n_a, n_b))


def _order(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of byte strings within their groups; equal but for padding, the shorter comes first."""
    width = -(-rows.shape[1] // 8) * 8
    words = np.zeros((len(rows), width), dtype=np.uint8)
    words[:, : rows.shape[1]] = rows
    keys = words.view(">u8")
    return np.lexsort([lengths, *(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)), group])


def repeat_spans(right: np.ndarray, n_right, left: np.ndarray, n_left, group, min_bytes: int) -> list[tuple[int, int, int]]:
    """Repeats at the anchors of whole groups, whose rows come in the order of their places.

    ``right`` has the bytes from each anchor on, ``left`` those before it, backwards. Returns ``(row, before, after)``:
    the string from ``before`` bytes before the row's anchor to ``after`` bytes behind its start has at least
    ``min_bytes`` and also stands at an earlier row of the group.

    The rows of a group in order of ``right`` are its part of the suffix array, and the common prefixes of neighbours
    its LCP table. A stack scan of that gives the tree of LCP intervals from the leaves up. In each interval, the rows
    are taken in the order of ``left``: where neighbours there differ, the repeat has reached its left end, and the
    nearest earlier row on either side has the longest common extension to the left.
    """
    n, out = len(group), []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    two = starts[sizes == 2]
    if len(two):
        before, after = _common(left[two], left[two + 1], n_left[two], n_left[two + 1]), _common(right[two], right[two + 1], n_right[two], n_right[two + 1])
        hit = before + after >= min_bytes
        out += zip((two[hit] + 1).tolist(), before[hit].tolist(), after[hit].tolist())
    more = np.repeat(sizes > 2, sizes)
    if not more.any():
        return out
    rows = np.flatnonzero(more)
    sa = rows[_order(right[rows], n_right[rows], group[rows])]
    lcp = np.append(_common(right[sa[:-1]], right[sa[1:]], n_right[sa[:-1]], n_right[sa[1:]]), 0)
    by_left = rows[_order(left[rows], n_left[rows], group[rows])]
    near = np.append(_common(left[by_left[:-1]], left[by_left[1:]], n_left[by_left[:-1]], n_left[by_left[1:]]), 0)
    rank = np.empty(n, dtype=np.int64)
    rank[by_left] = np.arange(len(rows))
    sa_l, lcp_l, near_l, by_left_l, rank_l = sa.tolist(), lcp.tolist(), near.tolist(), by_left.tolist(), rank.tolist()
    last = np.flatnonzero(np.concatenate((group[sa[1:]] != group[sa[:-1]], [True])))
    lo = 0
    for hi in last.tolist():
        for depth, a, b in lcp_intervals(lcp_l, lo, hi):
            members = sorted(rank_l[r] for r in sa_l[a : b + 1])
            for row, extent in _left_extensions(members, near_l, by_left_l):
                if extent + depth >= min_bytes:
                    out.append((row, extent, depth))
        lo = hi + 1
    return out


def lcp_intervals(lcp: list[int], lo: int, hi: int):
    """``(depth, first, last)`` of all LCP intervals of the suffixes ``lo..hi``, inner ones first; ``lcp[k]`` is that of
    the suffixes k and k + 1."""
    stack: list[tuple[int, int]] = []
    for k in range(lo, hi + 1):
        now = lcp[k] if k < hi else -1
        start = k
        while stack and stack[-1][0] > now:
            depth, start = stack.pop()
            yield depth, start, k
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, start))


def _left_extensions(members: list[int], near: list[int], rows: list[int]):
    """For rows given by rank in the order of their left contexts: the longest left context that each shares with an
    earlier row among them, if any."""
    n = len(members)
    best = [-1] * n
    gaps = []
    for x, y in zip(members, members[1:]):
        gaps.append(near[x] if y == x + 1 else min(near[x:y]))
    for order in (1, -1):
        stack: list[tuple[int, int]] = []  # (row, least common context from here to the next on the stack)
        span = range(n) if order == 1 else range(n - 1, -1, -1)
        reach = 1 << 30
        for k in span:
            row = rows[members[k]]
            while stack and stack[-1][0] > row:
                reach = min(reach, stack.pop()[1])
            if stack:
                best[k] = max(best[k], reach)
            stack.append((row, reach))
            nxt = k if order == 1 else k - 1
            reach = gaps[nxt] if 0 <= nxt < n - 1 else 0
    return [(rows[m], b) for m, b in zip(members, best) if b >= 0]


def _spans_of_groups(fragments: DataFrame, min_bytes: int) -> DataFrame:
    """``(doc_id, start, stop)`` of repeats in the rows ``(key, doc_id, pos, left, right)`` of groups of limited size."""
    reach = min_bytes - ANCHOR

    def scan(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= 5_000:
                cut = len(held) - 1
                while cut > 0 and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield work(held[:cut])
                    held = held[cut:]
        if held:
            yield work(held)

    def work(rows: list[tuple]) -> pa.RecordBatch:
        key, doc, pos, left, right = zip(*rows)
        left = [x[::-1] for x in left]
        n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        found = repeat_spans(_pad(right, min_bytes), n_right, _pad(left, reach), n_left, np.array(key), min_bytes)
        spans = [(doc[r], pos[r] - a, pos[r] + b) for r, a, b in found]
        columns = list(zip(*spans)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["doc_id", "start", "stop"])

    ordered = fragments.repartition("key").sortWithinPartitions("key", "doc_id", "pos")
    return ordered.mapInArrow(scan, _SPAN)


_PARTS = 16  # of a large group's rows, so that they meet what is known of the group in several tasks


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(_PARTS)).cast("int"))


def _on_all_parts(groups: DataFrame) -> DataFrame:
    """One row a group, for each of its parts."""
    return groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))


def _split_hot(hot: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """One round on groups too large for a task: ``(spans, smaller groups)``.

    Every row is compared with its group's lead, the one with most copies. A string that a row has in common with the
    lead is told by how far it begins before the anchor, and the earliest row with each is found by grouping rows by
    the extents of what they share with the lead; that settles all these strings. Other strings that a row repeats are
    shared with rows that have the same next byte behind the part in common, to the left or to the right. So each row
    goes on in the two groups of these bytes.
    """
    reach = min_bytes - ANCHOR
    lead = hot.groupBy("key").agg(F.max_by(F.struct("left", "right"), F.struct("n", -F.col("doc_id"), -F.col("pos"))).alias("lead"))

    def compare(batches):
        for batch in batches:
            key, doc, pos, left, right, n, of = (c.to_pylist() for c in batch.columns)
            back = [x[::-1] for x in left]
            n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
            of_l, of_r = [x["left"][::-1] for x in of], [x["right"] for x in of]
            before = _common(_pad(back, min_bytes), _pad(of_l, min_bytes), n_left, np.array([len(x) for x in of_l]))
            after = _common(_pad(right, min_bytes), _pad(of_r, min_bytes), n_right, np.array([len(x) for x in of_r]))
            columns = [*batch.columns[:6], pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "pos", "left", "right", "n", "before", "after"])

    met = _dealt(hot).join(_on_all_parts(lead), ["key", "part"]).select("key", "doc_id", "pos", "left", "right", "n", "lead")
    rows = materialize(met.mapInArrow(compare, _FRAGMENT + ", before int, after int"), "peel")
    cells = rows.where(F.col("before") + F.col("after") >= min_bytes).groupBy("key", "before", "after").agg(F.min(F.struct("doc_id", "pos")).alias("spot"))
    cells = cells.groupBy("key").agg(F.collect_list(F.struct("before", "after", "spot")).alias("cells"))  # at most the square of min_bytes

    def earliest(batches):
        for batch in batches:
            packed = []
            for own in batch.column(1).to_pylist():
                best = [_NEVER] * (reach + 1)
                for c in own:
                    spot = (c["spot"]["doc_id"], c["spot"]["pos"])
                    for o in range(max(0, min_bytes - c["after"]), min(reach, c["before"]) + 1):
                        best[o] = min(best[o], spot)
                packed.append(np.array(best, dtype=np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, type=pa.binary())], names=["key", "firsts"])

    firsts = cells.mapInArrow(earliest, "key long, firsts binary")

    def settle(batches):
        for batch in batches:
            out = []
            for doc, pos, before, after, packed in zip(*(c.to_pylist() for c in batch.columns)):
                lo = max(0, min_bytes - after)
                first = np.frombuffer(packed, dtype=np.int64).reshape(-1, 2)[lo : min(reach, before) + 1]
                earlier = (first[:, 0] < doc) | ((first[:, 0] == doc) & (first[:, 1] < pos))
                edges = np.flatnonzero(np.diff(np.concatenate(([False], earlier, [False])).astype(np.int8)))
                for a, b in edges.reshape(-1, 2).tolist():
                    out.append((doc, pos - (lo + b - 1), pos - (lo + a) + min_bytes))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["doc_id", "start", "stop"])

    common = _dealt(rows.where(F.col("before") + F.col("after") >= min_bytes)).join(_on_all_parts(firsts), ["key", "part"])
    spans = common.select("doc_id", "pos", "before", "after", "firsts").mapInArrow(settle, _SPAN)

    def branch(batches):
        for batch in batches:
            out = []
            for key, doc, pos, left, right, n, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                for side, at, text in ((0, before, left[::-1]), (1, after, right)):
                    if at < len(text):
                        digest = hashlib.blake2b(b"%d %d %d %d" % (key, side, at, text[at]), digest_size=8).digest()
                        out.append((int.from_bytes(digest, "little", signed=True), doc, pos, left, right, n))
            yield _fragment_batch(out)

    return spans, rows.mapInArrow(branch, _FRAGMENT)


_NEVER = ((1 << 63) - 1, 0)  # after every place
_SPAN = "doc_id long, start long, stop long"
_FRAGMENT = "key long, doc_id long, pos long, left binary, right binary, n long"


def _fragment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["key", "doc_id", "pos", "left", "right", "n"])


def _by_size(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that a task can hold, and of larger ones; rows alone in their group are left out."""
    sizes = fragments.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sized = materialize(fragments.join(sizes, "key"), "sized")
    return sized.where(F.col("size") <= GROUP).drop("size", "n"), sized.where(F.col("size") > GROUP).drop("size")


def repeated_spans(docs: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``(doc_id, start, stop)``: byte spans that together are all bytes covered by a string of ``min_bytes`` that also
    starts earlier (smaller doc_id, or same document and earlier start). Spans may overlap.

    1. Anchor hashes are counted; those met once are dropped. 2. Anchors of the others are classed by their whole
    fragment, and of each class all but the earliest are repeats as a whole. 3. Where an anchor has several classes,
    the earliest of each sends its bytes, and the suffix array of these gives the repeats between classes. Equality of
    anchors and fragments is that of 64-bit hashes; the bytes decide in 3.
    """
    reach = min_bytes - ANCHOR
    if reach < 1:
        raise ValueError(f"min_bytes must be over {ANCHOR}")
    texts = _texts(docs)
    often = materialize(anchors(texts, min_bytes).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "often")
    shared = materialize(anchors(texts, min_bytes).join(often, "hash"), "shared")
    spot = F.struct("doc_id", "pos")
    classes = materialize(shared.groupBy("hash", "fragment").agg(F.min(spot).alias("lead"), F.count("*").alias("n")), "classes")
    whole = shared.join(classes.where("n > 1").select("hash", "fragment", "lead"), ["hash", "fragment"]).where(spot != F.col("lead"))
    whole = whole.select("doc_id", (F.col("pos") - reach).alias("start"), (F.col("pos") + min_bytes).alias("stop"))
    several = classes.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash")
    leads = classes.join(several, "hash").select("hash", F.col("lead.doc_id").alias("doc_id"), F.col("lead.pos").alias("pos"), "n")
    wanted = leads.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "pos", "n")).alias("places"))

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, places, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8")
                for p in places:
                    at = p["pos"]
                    out.append((p["hash"], doc_id, at, raw[max(0, at - reach) : at], raw[at : at + min_bytes], p["n"]))
            yield _fragment_batch(out)

    pieces = wanted.hint("merge").join(texts, "doc_id").select("doc_id", "places", "text")
    fragments = materialize(pieces.mapInArrow(cut, _FRAGMENT), "pieces")
    found = [whole]
    while True:
        small, hot = _by_size(fragments)
        found.append(materialize(_spans_of_groups(small, min_bytes), "spans"))
        if hot.isEmpty():
            break
        spans, fragments = _split_hot(hot, min_bytes)
        found.append(materialize(spans, "spans"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def removed_mask(n: int, spans) -> tuple[np.ndarray, int]:
    """Which of ``n`` bytes the spans cover, and in how many runs."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if len(spans):
        np.add.at(edge, np.clip(spans[:, 0], 0, n), 1)
        np.add.at(edge, np.clip(spans[:, 1], 0, n), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return gone, int((gone & ~np.concatenate(([False], gone[:-1]))).sum())


def _with_spans(docs: DataFrame, min_bytes: int, name: str) -> DataFrame:
    """``docs`` with the spans of each row in a new column ``name``."""
    spans = repeated_spans(docs, min_bytes).groupBy("doc_id").agg(F.collect_list(F.array("start", "stop")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias(name + "_id"), F.col("spans").alias(name))
    return docs.join(spans.hint("merge"), F.col("doc_id").cast("long") == F.col(name + "_id"), "left").drop(name + "_id")


def _free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as set it apart from all columns."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    return name


def repeat_report(docs: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row.

    A null text is empty. Rows without doc_id neither repeat nor are repeated, and keep all their bytes. Repeated rows
    with one doc_id stand at the same place: none of them is earlier, and spans found in one count for all. Texts of any
    length are looked at whole, other columns are ignored, and an empty table gives an empty result.
    """

    def digest(batches):
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
                gone, runs = removed_mask(len(raw), np.array(spans or [], dtype=np.int64).reshape(-1, 2))
                out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), min_bytes, "spans")
    return rows.select("doc_id", "text", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, min_bytes: int = 100) -> DataFrame:
    """All columns of ``docs`` with the repeated bytes cut out of ``text``, and ``n_chars`` to match where there is one.

    A character that loses a byte goes as a whole. Documents of which nothing is left are dropped; those that were
    empty or null before stay as they are.
    """

    @F.arrow_udf("string")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, own in zip(texts.to_pylist(), spans.to_pylist()):
                if text is None:
                    out.append(None)
                    continue
                raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
                gone, _ = removed_mask(len(raw), np.array(own, dtype=np.int64).reshape(-1, 2))
                out.append(raw[~gone].tobytes().decode("utf-8", errors="ignore"))
            yield pa.array(out, type=pa.string())

    kept = kept.asNondeterministic()  # else the filter below takes a second run of it, in a Python worker more per task
    spans, rest = _free_name(docs, "spans"), _free_name(docs, "rest")
    marked = _with_spans(docs, min_bytes, spans)
    marked = marked.withColumn(rest, kept(F.when(F.col(spans).isNotNull(), F.col("text")), spans))  # only texts with repeats go to Python
    marked = marked.where(F.col(rest).isNull() | (F.col(rest) != ""))
    out = marked.withColumn("text", F.coalesce(rest, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(rest).isNotNull(), F.char_length(rest).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
