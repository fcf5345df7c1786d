"""Best-fit packing of documents into training sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.words import small_batches, word_encoder
from trekframe.storage import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SEQUENCES = 8192  # about as many sequences as a task fills
PACKED = PIECES + ", sequence_id long, offset long"


class OpenBins:
    """At most ``limit`` open bins; an integer's bit ``f`` is set while some open bin has ``f`` free tokens.

    ``place`` takes the open bin with the least free space that holds the piece, or opens one. When more than
    ``limit`` are open, the fullest is closed.
    """

    def __init__(self, size: int, limit: int, first_id: int):
        self.size, self.limit, self.next_id = size, limit, first_id
        self.bits, self.bins, self.n_open = 0, [[] for _ in range(size + 1)], 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self.bins[free].pop()
            self.n_open -= 1
            if not self.bins[free]:
                self.bits &= ~(1 << free)
        else:
            free, bin_id = self.size, self.next_id
            self.next_id += 1
        left = free - length
        if left:
            self.bins[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.limit:
                self._close_fullest()
        return bin_id, self.size - free

    def _close_fullest(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        self.bins[free].pop()
        self.n_open -= 1
        if not self.bins[free]:
            self.bits &= ~(1 << free)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: its ids and then ``end_id``, cut only if longer than ``max_tokens``."""

    def encode(batches):
        encoder, end = word_encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, max_tokens)):
                    stop = min(n, start + max_tokens)
                    for column, value in zip(out, (doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out, kinds)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, PIECES)


def pack_pieces(pieces: DataFrame, max_tokens: int = 2048, open_bins: int = 1024, partitions: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. Each partition packs its pieces on their own, in a fixed order.

    A partition ends with some sequences unfilled, so there is one for every ``SEQUENCES`` that the tokens need, at any
    setting of the session, unless ``partitions`` says how many.

    Pieces are dealt by a hash of document and piece, so that one long or repeated document cannot crowd a task, and
    the order within a partition is by hash too: the lengths come mixed, and a task that is run again gives the same.
    """
    if partitions is None:
        total = pieces.agg(F.sum("length")).first()[0] or 0
        partitions = 1 + total // (SEQUENCES * max_tokens)

    def pack(batches):
        bins = OpenBins(max_tokens, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(x) for x in batch.column("length").to_pylist()]
            extra = [pa.array([p[i] for p in placed], type=pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *extra], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    dealt = pieces.repartition(partitions, F.xxhash64("doc_id", "piece"))
    ordered = dealt.sortWithinPartitions(F.xxhash64("piece", "doc_id"), "doc_id", "piece", "start", "length", "ids_crc32")
    return ordered.mapInArrow(pack, PACKED)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, open_bins: int = 1024, end_id: int = 0, partitions: int | None = None
) -> DataFrame:
    """Packs every document's tokens into sequences of at most ``max_tokens``.

    Bounded-space online best-fit: at most ``open_bins`` open sequences in a task, kept in a bitset by free space; a
    piece goes to the one it fills best, and when too many are open the fullest closes first. A null or empty text is
    its end token alone, and a text of any length is encoded whole. Rows are packed one by one: repeated rows and null
    ids are packed as they come. Other columns are ignored. An empty table gives an empty result.
    """
    return pack_pieces(materialize(token_pieces(docs, tokenizer_path, max_tokens, end_id), "pieces"), max_tokens, open_bins, partitions)
