"""Token-id output by best-fit-decreasing packing (operator 5).

Every text is tokenised with a public vocabulary and its ids are cut, without loss, into segments
of at most ``seq_len``.  Segments are placed longest first, each into the fullest open row that
still has room for it: a segment tree over capacities (how many open rows have each amount of room)
answers "smallest room of at least n" in O(log seq_len).  A packed row is one row of the id matrix,
with cumulative segment lengths, the position at which each segment resumes its document, and a row
of the matrix of position ids, which begin anew at every segment.

Scale: packing is local to a shard of at most ``SHARD_TOKENS`` ids inside one input split, so
nothing is shuffled, memory is bounded by a parameter, and a lost task repeats only its own shard.
A shard has thousands of segments, for which best-fit-decreasing leaves well under one per cent of
padding: wider packing would buy nothing.  Row ids are (shard, row number); a shard's number is the
partition's and its own within it, so it is unique whatever the doc_ids are.

Defined results: null and empty texts have no ids and take part in no row; a document longer than
``seq_len`` is split in order, no id is dropped; repeated rows are packed each; null doc_ids are
carried; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import kept, small_batches, struct, table

VOCABULARY = "byte_bpe_50k.tiktoken"
SEQ_LEN = 2048
#: Ids held by a task before it packs and emits them: 2 bytes each.
SHARD_TOKENS = 4_000_000

PACKED = struct("shard long, row int, n_tokens int, n_segments int, doc_ids array<long>, doc_offsets array<int>, cu_seqlens array<int>, ids binary, position_ids binary")


class RoomTree:
    """Counts of open rows by room 0..size in a segment tree; finds the least room of at least n."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, change: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += change
            at //= 2

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room >= need."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at % 2 or not self.count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        self._add(room, -1)
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment indexes; each row's lengths sum to at most ``capacity``."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[i])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], row)
    return rows


def encoder(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    def build():
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("tessera", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return kept(f"packing:{vocabulary}", build)


def end_of_text(encode: tiktoken.Encoding) -> int:
    """The first id that the vocabulary leaves free: it ends each document, and pads rows."""
    return encode.max_token_value + 1


def width(largest: int) -> str:
    """The little-endian unsigned type of a matrix whose largest number is this."""
    return "<u2" if largest < 1 << 16 else "<u4"


def pack_shard(documents: list[tuple[int | None, np.ndarray]], seq_len: int, end: int, shard: int = 0) -> Iterator[tuple]:
    """Packed rows of one shard of (doc_id, ids); ``end`` is the largest id."""
    segments = [(d, start) for d, (_, ids) in enumerate(documents) for start in range(0, len(ids), seq_len)]
    lengths = [min(seq_len, len(documents[d][1]) - start) for d, start in segments]
    places = np.arange(seq_len, dtype=width(seq_len - 1))
    for number, row in enumerate(best_fit_decreasing(lengths, seq_len)):
        ids, positions = np.full(seq_len, end, dtype=width(end)), np.zeros(seq_len, dtype=places.dtype)
        ends, doc_ids, offsets, at = [0], [], [], 0
        for i in row:
            d, start = segments[i]
            ids[at : at + lengths[i]] = documents[d][1][start : start + lengths[i]]
            positions[at : at + lengths[i]] = places[: lengths[i]]
            at += lengths[i]
            ends.append(at)
            doc_ids.append(documents[d][0])
            offsets.append(start)
        yield shard, number, at, len(row), doc_ids, offsets, ends, ids.tobytes(), positions.tobytes()


def pack_documents(docs: DataFrame, key: str = "doc_id", seq_len: int = SEQ_LEN, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per packed row: ids and position_ids (seq_len little-endian unsigned numbers of :func:`width`, padded), cu_seqlens, doc_ids and doc_offsets."""
    arrow = to_arrow_schema(PACKED)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, n = encoder(vocabulary), [], 0
        end, shards = end_of_text(encode), count(TaskContext.get().partitionId() << 32)

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in pack_shard(held, seq_len, end, next(shards)):
                rows.append(row)
                if len(rows) == 256:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                ids = np.array([*encode.encode_ordinary(text), end], dtype=width(end))
                held.append((doc_id, ids))
                n += len(ids)
                if n >= shard_tokens:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return docs.select(F.col(f"`{key}`").cast("long"), "text").mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed matrices as Parquet files in a shared store (Spark's committer survives lost tasks)."""
    packed.write.mode("overwrite").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every packed row of the whole corpus, with its matrix row."""
    return pack_documents(table(spark, sf_dir, "documents"))
