"""Packing token ids into rows of fixed length by best-fit decreasing.

A document's ids, closed by an end id, are cut into full rows and a rest; rests go, longest first, each into the row with
the least room that still holds it. A segment tree over the possible amounts of room finds that row in logarithmic time.
Each packed row carries its ids as a little-endian matrix row, the cumulative lengths of its segments, the places where
positions start again at 0, and for each segment the document and where in it the segment begins, so that nothing is lost.

Scale: a map without shuffle. A task packs blocks of about ``block`` ids, which bounds its memory; blocks are large against
a row, so the room lost at their ends is small.

Edge cases: null text is empty and packs as its end id alone; null ids of documents stay null in doc_ids; repeated rows are
packed each; a document of any length is cut without loss; ids of documents may be of any type; other columns do not go into
packs, whatever their names; an empty table gives no rows. Rests of equal length go in the order of their documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches_of, load, merger

#: Columns of a packed row; doc_ids are of the key's own type.
SCHEMA = "pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{key}>, doc_starts array<int>"


class Rooms:
    """Rows by their room; the tree says under which nodes there are any."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.width
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of at least so much: (room, row)."""
        k = least + self.width
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):  # up to where a right sibling has rows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.width
        row = self.rows[room].pop()
        while k:
            self.count[k] -= 1
            k >>= 1
        return room, row


def best_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (item, start, end): full slices of each item first, then its rest by best-fit decreasing."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for i, n in enumerate(lengths):
        full = n - n % capacity
        rows += [[(i, a, a + capacity)] for a in range(0, full, capacity)]
        if n > full:
            rests.append((i, full, n))
    rooms = Rooms(capacity)
    for i, a, b in sorted(rests, key=lambda x: (x[1] - x[2], x[0])):
        room, row = rooms.take(b - a) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append((i, a, b))
        if room > b - a:
            rooms.add(room - (b - a), row)
    return rows


def stored_ids(column: pa.Array) -> Iterator[np.ndarray]:
    return (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, dtype=np.int32) for x in column)


def pack(
    tokens: DataFrame, *, capacity: int = 2048, end_id: int = 50256, vocabulary: int = 50257, key: str = "doc_id", ids: str = "ids",
    block: int = 2_000_000, ids_of: Callable[[pa.Array], Iterator[np.ndarray]] = stored_ids
) -> DataFrame:
    """Packed rows of SCHEMA; ids are uint16 if the vocabulary allows, else uint32. ids_of reads them from the column."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    keyed = tokens.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{ids}`").alias("_ids"))
    schema = SCHEMA.format(key=keyed.schema["_key"].dataType.simpleString())

    def packed(docs: list, parts: list[np.ndarray], first: int, of_key: pa.DataType) -> pa.RecordBatch:
        rows = best_fit([len(x) for x in parts], capacity)
        out = {k: [] for k in ("pack_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_starts")}
        for k, row in enumerate(rows):
            ends = np.cumsum([b - a for _, a, b in row])
            values = (
                first + k, np.concatenate([parts[i][a:b] for i, a, b in row]).astype(kind).tobytes(), int(ends[-1]), [0, *ends.tolist()],
                [0, *ends[:-1].tolist()], [docs[i] for i, _, _ in row], [a for _, a, _ in row]
            )
            for name, v in zip(out, values, strict=True):
                out[name].append(v)
        types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(of_key), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        docs, parts, size, of_key = [], [], 0, pa.int64()
        for b in batches:
            of_key = b.column(0).type
            for doc, own in zip(b.column(0).to_pylist(), ids_of(b.column(1)), strict=True):
                docs.append(doc)
                closed = np.empty(len(own) + 1, dtype=kind)
                closed[:-1], closed[-1] = own, end_id
                parts.append(closed)
                size += len(parts[-1])
                if size >= block:
                    yield (out := packed(docs, parts, made, of_key))
                    made += out.num_rows
                    docs, parts, size = [], [], 0
        if parts:
            yield packed(docs, parts, made, of_key)

    return keyed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, *, text: str = "text", **how) -> DataFrame:
    """Encode and pack in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def ids_of(column: pa.Array) -> Iterator[np.ndarray]:
        m = merger(path, shared.value)
        for some in batches_of(t.as_py() or "" for t in column):
            yield from m.encode(some)

    return pack(docs, ids=text, ids_of=ids_of, **how)


def write(packs: DataFrame, path: str) -> None:
    """The packed matrix as Parquet: one binary row of ids per pack, with its lengths and resets."""
    packs.write.mode("overwrite").parquet(path)
