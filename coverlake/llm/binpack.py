"""Packing pieces of documents into sequences by swap-based local search.

A document's ids, closed by an end id, are cut into pieces of the full length and a rest. A full piece is a sequence of its
own. The rests of a block start best-fit decreasing; then bins that are not full exchange pieces: one moves over, or one or
two go over for one that comes back (or one for two), wherever the fuller bin gains. Each exchange raises the sum of the
squared fills, so the search ends, and what is short gathers in ever fewer bins until they empty.

Scale: pieces are numbered and stored with their ids, then only numbers and lengths are dealt, by a digest of the number, into
blocks of about ``block`` rests. At the end of a block's search at most one bin is half empty, as two such would have been
joined; those last bins of many blocks meet once more, in as many further rounds as it takes until they fit one block. So the
loss against one search over all is a part of one bin for each ``block`` rests, and no task holds more than a block.

Edge cases: null text is empty, and its piece is the end id alone; null and repeated document ids are packed row by row; texts
of any length are cut without loss; equal lengths go by the number of the piece, so a rerun over the stored pieces packs
alike; other columns of the documents stay with each piece, and those named like the results give way; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unpacked
from .packing import best_fit
from .word_bpe import encoder, load_words

#: Bytes of text that are encoded at once, about.
BATCH = 2 << 20


def pieces(docs: DataFrame, path: str, *, text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The columns of docs but for the text, then for each piece: piece (from 0), start (ids of its document before it), length,
    ids (binary: little-endian unsigned numbers of 32 bits) and piece_at, a number of its own. Stored."""
    columns = [c for c in docs.columns if c != text]
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), F.coalesce(docs[f"`{text}`"].cast("binary"), F.lit(b"")).alias("_text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(load_words(path))
    zero = F.lit(0).cast("long")
    schema = rows.select(
        "_row", F.lit(0).alias("_piece"), zero.alias("_start"), zero.alias("_length"), F.lit(b"").alias("_ids"), zero.alias("_at")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, shared.value)
        made = TaskContext.get().partitionId() << 40
        for b in batches:
            sizes = np.diff(
                b.column(1).offsets.to_numpy() if hasattr(b.column(1), "offsets")
                else np.concatenate([[0], np.cumsum([len(x.as_py()) for x in b.column(1)])])
            )
            group = np.cumsum(sizes) // BATCH
            for own in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(group)) + 1):
                part = b.slice(int(own[0]), len(own))
                flat, size = words.encode([x.as_py() for x in part.column(1)])
                size = size + 1
                closed = np.full(int(size.sum()), end_id, dtype="<u4")
                ends = np.cumsum(size)
                inner = np.ones(len(closed), dtype=bool)
                inner[ends - 1] = False
                closed[inner] = flat
                count = -(-size // capacity)
                of = np.repeat(np.arange(len(own)), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[of] - start, capacity)
                first = (ends - size)[of] + start
                whole = closed.tobytes()
                ids = [whole[4 * a : 4 * (a + n)] for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [
                    part.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(made + np.arange(len(of)), pa.int64())
                ]
                made += len(of)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    added = {"piece": F.col("_piece"), "start": F.col("_start"), "length": F.col("_length"), "ids": F.col("_ids"), "piece_at": F.col("_at")}
    return unpacked(rows.mapInArrow(run, schema), columns, added)


class Offers:
    """What bins have to give, by its size: of each size the emptiest bin that still takes part."""

    def __init__(self, of_bins: dict[int, dict[int, tuple[int, ...]]], fill: list[int], capacity: int):
        self.of_bins, self.fill = of_bins, fill
        self.owners: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b in sorted(of_bins, key=lambda b: (-fill[b], b)):
            for x in of_bins[b]:
                self.owners[x].append(b)
        self.least = np.array([fill[o[-1]] if o else capacity + 1 for o in self.owners])
        self.gone: set[int] = set()

    def leave(self, b: int) -> None:
        self.gone.add(b)
        for x in self.of_bins[b]:
            own = self.owners[x]
            while own and own[-1] in self.gone:
                own.pop()
            self.least[x] = self.fill[own[-1]] if own else len(self.least)

    def largest(self, over: int, upto: int, fill: int) -> int:
        """The largest size over the first and up to the second number that a bin of at most this fill has; 0 if none."""
        have = np.flatnonzero(self.least[over + 1 : upto + 1] <= fill)
        return over + 1 + int(have[-1]) if len(have) else 0

    def take(self, size: int) -> tuple[int, tuple[int, ...]]:
        b = self.owners[size][-1]
        return b, self.of_bins[b][size]


class Search:
    """Bins of lengths that are not full, improved by exchanges until none helps."""

    def __init__(self, bins: list[list[int]], capacity: int):
        self.bins, self.capacity = [sorted(b) for b in bins], capacity
        self.fill = [sum(b) for b in self.bins]

    def least(self) -> int:
        """No fewer bins can hold all."""
        return -(-sum(self.fill) // self.capacity)

    def used(self) -> int:
        return sum(f > 0 for f in self.fill)

    def couples(self, b: int) -> dict[int, tuple[int, int]]:
        """A pair of pieces for each sum that two of this bin's pieces have."""
        n = Counter(self.bins[b])
        own = sorted(n)
        out = {}
        for i, x in enumerate(own):
            for y in own[i + (n[x] < 2) :]:
                if x + y > self.capacity:
                    break
                out.setdefault(x + y, (x, y))
        return out

    def give(self, a: int, b: int, there: tuple[int, ...], back: tuple[int, ...]) -> None:
        """The pieces ``there`` go from bin b to bin a, ``back`` from a to b."""
        for x in there:
            self.bins[b].remove(x)
            self.bins[a].append(x)
        for y in back:
            self.bins[a].remove(y)
            self.bins[b].append(y)
        gain = sum(there) - sum(back)
        self.fill[a] += gain
        self.fill[b] -= gain

    def best(self, a: int, one: Offers, two: Offers) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange that fills bin a most, with a bin that is not fuller: (bin, there, back)."""
        fill, room, gain, found = self.fill[a], self.capacity - self.fill[a], 0, None
        backs: dict[int, tuple[int, ...]] = self.couples(a) | {y: (y,) for y in self.bins[a]} | {0: ()}
        for size, back in sorted(backs.items(), key=lambda x: (len(x[1]), x[0])):
            for offers in (one, two)[: 1 + (len(back) < 2)]:
                if size + gain < self.capacity and (x := offers.largest(size + gain, min(size + room, self.capacity), fill)):
                    gain, found = x - size, (*offers.take(x), back)
                    if gain == room:
                        return found
        return found

    def run(self) -> list[list[int]]:
        """The bins that are left. In a round each bin takes part in one exchange at most, fullest bins first."""
        while self.used() > self.least():
            open_ = [b for b, f in enumerate(self.fill) if 0 < f < self.capacity]
            fill = list(self.fill)
            one = Offers({b: {x: (x,) for x in self.bins[b]} for b in open_}, fill, self.capacity)
            two = Offers({b: self.couples(b) for b in open_}, fill, self.capacity)
            moved = False
            for a in sorted(open_, key=lambda b: (-fill[b], b)):
                if a in one.gone:
                    continue
                one.leave(a)
                two.leave(a)
                if got := self.best(a, one, two):
                    moved = True
                    one.leave(got[0])
                    two.leave(got[0])
                    self.give(a, *got)
            if not moved:
                break
        return [b for b in self.bins if b]


def pack_block(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in lengths (each at most capacity): best fit, then the search over the bins that are not full."""
    start = [[i for i, _, _ in row] for row in best_fit(lengths, capacity)]
    filled = [sum(lengths[i] for i in b) for b in start]
    full = [b for b, f in zip(start, filled, strict=True) if f == capacity]
    rest = [b for b, f in zip(start, filled, strict=True) if f < capacity]
    free: dict[int, list[int]] = {}
    for b in reversed(rest):
        for i in reversed(b):
            free.setdefault(lengths[i], []).append(i)
    found = Search([[lengths[i] for i in b] for b in rest], capacity).run()
    return full + [[free[x].pop() for x in b] for b in found]


def place(rests: DataFrame, capacity: int, block: int) -> DataFrame:
    """rests: piece_at, length. With _block, _bin, offset and _fill (that of the bin) for each."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("piece_at", ignore_index=True)
        lengths = own["length"].tolist()
        n, fill, offset = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
        for k, b in enumerate(pack_block(lengths, capacity)):
            at = 0
            for i in b:
                n[i], offset[i] = k, at
                at += lengths[i]
            fill[b] = at
        return own.assign(_bin=n, offset=offset, _fill=fill)

    blocks = max(1, -(-rests.count() // block))
    dealt = rests.withColumn("_block", F.pmod(F.xxhash64("piece_at"), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(run, "piece_at long, length long, _block long, _bin long, offset long, _fill long")


def pack(parts: DataFrame, *, capacity: int = 2048, block: int = 1 << 14) -> DataFrame:
    """parts: what pieces() returns, stored, with any columns but these: piece_at and length. Its columns, then sequence_id
    and offset."""
    rests = parts.filter(F.col("length") < capacity).select("piece_at", "length")
    done, level = None, 0
    while True:
        placed = stored(place(rests, capacity, block))
        last = placed.filter(F.col("_fill") * 2 <= capacity).select("piece_at", "length")
        more = placed.select("_block").distinct().count() > 1
        settled = placed.filter(F.col("_fill") * 2 > capacity) if more else placed
        level += 1
        # numbers of a round, a block and a bin in it
        number = F.lit(level << 56).bitwiseOR(F.shiftleft("_block", 24)).bitwiseOR(F.col("_bin"))
        settled = settled.select(F.col("piece_at").alias("_at"), number.alias("_sequence"), F.col("offset").alias("_offset"))
        done = settled if done is None else done.unionByName(settled)
        if not more:
            break
        rests = last
    columns = [c for c in parts.columns if c != "piece_at"]
    rows = parts.select(
        F.struct(*[parts[f"`{c}`"] for c in columns]).alias("_row"), F.col("piece_at").alias("_at"), F.col("length").alias("_length")
    )
    whole = rows.filter(F.col("_length") == capacity).select(
        "_row", (-1 - F.col("_at")).alias("_sequence"), F.lit(0).cast("long").alias("_offset")
    )
    shared = rows.filter(F.col("_length") < capacity).join(done, "_at").select("_row", "_sequence", "_offset")
    return unpacked(whole.unionByName(shared), columns, {"sequence_id": F.col("_sequence"), "offset": F.col("_offset")})


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence: its ids in a row (binary) and the cumulative lengths of its pieces."""
    own = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("own"))
    ids = F.expr("aggregate(own, cast('' as binary), (a, p) -> concat(a, p.ids))")
    return own.select(
        "sequence_id", ids.alias("ids"),
        F.concat(F.array(F.lit(0).cast("long")), F.transform("own", lambda p: p["offset"] + p["length"])).alias("cu_seqlens")
    )


def pack_documents(docs: DataFrame, path: str, *, text: str = "text", capacity: int = 2048, block: int = 1 << 14) -> DataFrame:
    """Each piece of each document with its ids and its place."""
    return pack(stored(pieces(docs, path, text=text, capacity=capacity)), capacity=capacity, block=block)
