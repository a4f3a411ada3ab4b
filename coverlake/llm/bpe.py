"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

A piece of text starts as one symbol per byte. The leaves of the tree hold, for each symbol, the rank of its pair with the
next one (and its place, so that the leftmost of equal ranks is the least); the root is the merge to make. A merge changes
three leaves, so three paths are updated, until the root holds no rank. Many short pieces are merged side by side, as rows of
one numpy array; a long piece has a tree of its own, so its cost stays n log n.

Scale: a map over batches without shuffle. Each worker remembers the ids of up to ``CACHE`` pieces; of more, the more used
half stays, so its memory is bounded while common pieces are merged once. What is broadcast is the vocabulary, which is fixed.

Edge cases: null text is empty and has no ids; special tokens in a text get their own id; texts of any length are encoded
whole; null ids decode to the empty text; an empty table gives an empty table; input columns named like the results give way.
Repeated rows are encoded each, alike; of equal ranks the leftmost pair merges first.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unpacked
from .tables import Table

#: Fixed values of byte-level BPE: how a text is cut into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = regex.compile("'(?:s|t|re|ve|m|ll|d)")
LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)
NONE = np.int32(2**31 - 1)
#: Pieces whose ids a worker remembers.
CACHE = 400_000
#: Pieces of up to so many bytes are merged side by side.
SIDE_BY_SIDE = 64
#: So many pieces at once, and ids.
ROWS, PART = 1 << 14, 1 << 18
#: The lowest bytes of a number, by how many.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return out | {chr(256 + k): b for k, b in enumerate(hidden)}


def kinds() -> np.ndarray:
    """The kind of each code point in PIECES' terms."""
    out = np.full(0x110001, OTHER, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    shift = lambda k: k if k < 0xD800 else k + 0x800  # noqa: E731  surrogates are left out
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[shift(m.start()) : shift(m.end() - 1) + 1] = kind
    out[0x110000] = BREAK
    return out


def cut(texts: list[str], kind: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of each text, as PIECES finds them, on one array of all code points: the texts in a row, their code points,
    where pieces start and end, and for each text (and the end) the number of its first piece.

    A piece is a run of one kind; the space before it belongs to it, and leaves a longer run of white space.
    """
    whole = "\0".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1, out=starts[1:])
    k = np.empty(len(codes) + 1, dtype=np.uint8)
    np.take(kind, codes, out=k[:-1])
    k[starts[1:] - 1] = BREAK
    change = k[1:] != k[:-1]
    first = np.empty(len(k), dtype=bool)
    first[0] = True
    first[1:] = change
    space = k == SPACE
    breaks = starts[1:] - 1
    first[breaks] = True
    first[breaks[:-1] + 1] = True
    ends_of_space = np.flatnonzero(space[:-1] & change)
    followed = ends_of_space[k[ends_of_space + 1] != BREAK]
    first[followed] = True  # the last white space stands alone, or
    joined = followed[codes[followed] == 32]
    first[joined + 1] = False  # as a space belongs to what follows
    # contractions: an apostrophe alone that begins a piece, before letters
    quote = np.flatnonzero((codes == 39) & first[:-1] & (k[1:] == LETTER))
    for i in quote.tolist():
        if m := CONTRACTIONS.match(whole, i):
            first[i + 1] = False
            first[m.end()] = True
    every = np.flatnonzero(first)
    piece = k[every] != BREAK
    at = every[piece]
    ends = np.append(every[1:], len(k))[piece]
    return whole, codes, at, ends, np.searchsorted(at, starts)


def load(path: str) -> dict:
    """The arrays of a tokenizers JSON file of kind byte-level BPE; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, names = d["model"], byte_names()
    vocab = model["vocab"]
    added = {t["content"]: t["id"] for t in d["added_tokens"]}
    size = max([*vocab.values(), *added.values()]) + 1
    raw = [b""] * size
    for token, i in vocab.items():
        raw[i] = bytes(names[c] for c in token)
    for token, i in added.items():
        raw[i] = token.encode()
    first = np.zeros(256, dtype=np.int32)
    for c, b in names.items():
        first[b] = vocab[c]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], dtype=np.int64).reshape(-1, 3)
    keys = pairs[:, 0] << 32 | pairs[:, 1]
    order = np.argsort(keys, kind="stable")
    return {
        "raw": raw, "first": first, "keys": keys[order], "ranks": order.astype(np.int32), "made": pairs[:, 2].astype(np.int32),
        "added": added
    }


class Remembered:
    """Ids of pieces seen before. A piece of up to 15 bytes is found by these and its length, as two numbers, in a table by
    open addressing; longer ones by a dict. Of too many pieces the more used half stays."""

    def __init__(self, most: int = CACHE):
        self.most = most
        self.start()

    def start(self) -> None:
        self.bits = int(2 * self.most).bit_length()
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.low, self.high = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.first, self.size, self.uses = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)
        self.long: dict[bytes, int] = {}

    def home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ high * np.uint64(0xD1342543DE82EF95)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for those not there."""
        at = self.home(low, high)
        out = self.slots[at]
        if not len(self.low):
            return out
        open_ = np.flatnonzero(((self.low[out] != low) | (self.high[out] != high)) & (out >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (1 << self.bits) - 1
            out[open_] = now = self.slots[at[open_]]
            open_ = open_[((self.low[now] != low[open_]) | (self.high[now] != high[open_])) & (now >= 0)]
        return out

    def put(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, size: np.ndarray, raw: list[bytes] | None = None) -> int:
        """Add pieces, distinct and not there yet; longer ones with raw, and zeros for low and high. The number of the first."""
        n, now = len(self.size), np.arange(len(self.size), len(self.size) + len(size), dtype=np.int32)
        first = np.zeros(len(size), dtype=np.int64)
        np.cumsum(size[:-1], out=first[1:])
        self.first = np.append(self.first, first + len(self.ids))
        self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)
        self.uses = np.append(self.uses, np.zeros(len(size), dtype=np.int64))
        self.low, self.high = np.append(self.low, low), np.append(self.high, high)
        if raw is not None:
            self.long.update(zip(raw, now.tolist(), strict=True))
            return n
        if 2 * len(self.size) > len(self.slots):
            self.bits = int(2 * len(self.size)).bit_length()
            self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
            now = np.flatnonzero(self.high > 0).astype(np.int32)
        at = self.home(self.low[now], self.high[now])
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = now[free]  # of those that want a slot the last one gets it
            lost = self.slots[at] != now
            at, now = (at[lost] + 1) & (1 << self.bits) - 1, now[lost]
        return n

    def use(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces in a row, and how many each has."""
        self.uses += np.bincount(pieces, minlength=len(self.uses))
        size = self.size[pieces]
        ends = np.cumsum(size, dtype=np.int64)
        shift = self.first[pieces]
        shift[1:] -= ends[:-1]
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(shift, size)
        return self.ids[at], size

    def trim(self) -> None:
        """Forget the less used pieces if there are too many; uses count half from then on."""
        if len(self.size) <= self.most and len(self.ids) <= 8 * self.most:
            return
        order = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        keep = np.sort(order[(self.uses[order] > 1) & (np.cumsum(self.size[order], dtype=np.int64) <= 4 * self.most)])
        low, high, uses, raw = self.low[keep], self.high[keep], self.uses[keep] // 2, {k: x for x, k in self.long.items()}
        longer = np.array([k in raw for k in keep.tolist()], dtype=bool)
        short, long = keep[~longer], keep[longer]
        (a, n), (b, m) = self.use(short), self.use(long)
        self.start()
        self.put(low[~longer], high[~longer], a, n)
        self.put(low[longer], high[longer], b, m, [raw[k] for k in long.tolist()])
        self.uses = np.concatenate([uses[~longer], uses[longer]])


class Merger:
    """Encodes texts with the arrays of load()."""

    def __init__(self, model: dict):
        self.first, self.keys, self.ranks, self.made = (model[k] for k in ("first", "keys", "ranks", "made"))
        self.added = model["added"]
        self.table = Table(self.keys.astype(np.uint64))
        self.scalar = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        n = len(self.first)
        self.of_bytes = self.rank(np.repeat(self.first, n), np.tile(self.first, n)).reshape(n, n)
        self.kind = kinds()
        self.special = regex.compile(
            "(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")"
        ) if self.added else None
        self.pieces = Remembered()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 for those that do not merge."""
        at = self.table.find((left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).reshape(-1)).reshape(left.shape)
        return np.where((at >= 0) & (left >= 0) & (right >= 0), self.ranks[at], np.int32(-1))

    def side_by_side(self, raw: np.ndarray, start: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pieces of up to width bytes (a power of two) that start there in raw, one tree per row: their ids in a
        row, and how many each has."""
        n = len(start)
        place = np.arange(width, dtype=np.int32)
        filled = place < lengths[:, None]
        own = raw[np.where(filled, start[:, None] + place, 0)]
        sym = np.full((n, width + 1), -1, dtype=np.int32)  # the last column stands for "no symbol"
        sym[:, :width] = np.where(filled, self.first[own], -1)
        after = np.where(np.arange(1, width + 2) < lengths[:, None], np.arange(1, width + 2, dtype=np.int32), np.int32(width))
        before = np.broadcast_to(np.concatenate([[np.int32(width)], place]), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), NONE)
        ranks = np.where(filled[:, 1:], self.of_bytes[own[:, :-1], own[:, 1:]], np.int32(-1))
        tree[:, width:-1] = np.where(ranks >= 0, ranks * np.int32(width) + place[:-1], NONE)
        for k in range(width.bit_length() - 2, -1, -1):
            row = tree[:, 2 << k : 4 << k]
            np.minimum(row[:, ::2], row[:, 1::2], out=tree[:, 1 << k : 2 << k])
        rows, flat = np.flatnonzero(tree[:, 1] < NONE), tree.reshape(-1)
        while len(rows):
            rank, left = np.divmod(tree[rows, 1], np.int32(width))
            right = after[rows, left]
            beyond, earlier = after[rows, right], before[rows, left]
            merged = self.made[rank]
            sym[rows, left], sym[rows, right] = merged, -1
            after[rows, left] = beyond
            has = np.flatnonzero(beyond < width)
            before[rows[has], beyond[has]] = left[has]
            # three leaves change: the pairs that now begin at left and before it, and the one at right, which is gone
            prior = np.flatnonzero(earlier < width)
            ranks = self.rank(
                np.concatenate([merged, sym[rows[prior], earlier[prior]]]), np.concatenate([sym[rows, beyond], merged[prior]])
            )
            leaf = np.concatenate([left, earlier[prior]])
            base = np.concatenate([rows, rows[prior], rows]) * (2 * width)
            node = np.concatenate([leaf, right]) + width
            flat[base + node] = np.concatenate([np.where(ranks >= 0, ranks * np.int32(width) + leaf, NONE), np.full(len(rows), NONE)])
            for _ in range(width.bit_length() - 1):
                node >>= 1
                below = base + 2 * node
                flat[base + node] = np.minimum(flat[below], flat[below + 1])
            rows = rows[tree[rows, 1] < NONE]
        live = sym[:, :width] >= 0
        return sym[:, :width][live], live.sum(axis=1, dtype=np.int32)

    def alone(self, piece: bytes) -> np.ndarray:
        """Merge one long piece."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        sym = self.first[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        none, get, made = 1 << 62, self.scalar.get, self.made
        ranks = self.rank(np.array(sym[:-1]), np.array(sym[1:])).astype(np.int64)
        leaves = np.full(width, none)
        leaves[: n - 1] = np.where(ranks >= 0, ranks * width + np.arange(n - 1), none)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *chain.from_iterable(x.tolist() for x in reversed(levels))]

        def put(leaf: int, value: int) -> None:
            k = leaf + width
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low

        while tree[1] < none:
            rank, left = divmod(tree[1], width)
            right = after[left]
            beyond = after[right]
            sym[left], sym[right] = int(made[rank]), -1
            after[left] = beyond
            put(right, none)
            r = None
            if beyond >= 0:
                before[beyond] = left
                r = get(sym[left] << 32 | sym[beyond])
            put(left, none if r is None else r * width + left)
            if (e := before[left]) >= 0:
                r = get(sym[e] << 32 | sym[left])
                put(e, none if r is None else r * width + e)
        return np.array([s for s in sym if s >= 0], dtype=np.int32)

    def merge(self, raw: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of pieces in raw, in parts: which ones, their ids in a row, and how many each has."""
        # the least power of two that holds the piece; 0 for those with a tree of their own
        width = np.where(lengths > SIDE_BY_SIDE, 0, 1 << np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)))
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            for k in range(0, len(mine), ROWS if w else 1):
                part = mine[k : k + (ROWS if w else 1)]
                if w:
                    yield part, *self.side_by_side(raw, start[part], lengths[part], w)
                else:
                    ids = self.alone(raw[start[k_ := part[0]] : start[k_] + lengths[k_]].tobytes())
                    yield part, ids, np.array([len(ids)], dtype=np.int32)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ordinary texts in a row, and where those of each text (and the end) begin."""
        whole, codes, at, ends, of_text = cut(texts, self.kind)
        if not len(at):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        utf8 = whole.encode("utf-8", "surrogatepass")
        raw = np.frombuffer(utf8 + bytes(16), dtype=np.uint8)
        if len(utf8) != len(codes):
            place = np.zeros(len(codes) + 1, dtype=np.int64)
            np.cumsum(1 + (codes >= 0x80).view(np.int8) + (codes >= 0x800).view(np.int8) + (codes >= 0x10000).view(np.int8), out=place[1:])
            at, ends = place[at], place[np.minimum(ends, len(codes))]
        lengths = ends - at
        words = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
        low, high = words[at] & LOW[np.minimum(lengths, 8)], words[at + 8] & LOW[np.clip(lengths - 8, 0, 7)]
        high |= lengths.astype(np.uint64) << np.uint64(56)
        self.pieces.trim()
        found = self.pieces.find(low, high)
        longer = np.flatnonzero(lengths > 15)
        if len(longer):
            own = [utf8[a:b] for a, b in zip(at[longer].tolist(), ends[longer].tolist(), strict=True)]
            found[longer] = [self.pieces.long.get(x, -1) for x in own]
            if new := {x: k for k, x in zip(longer.tolist(), own, strict=True) if x not in self.pieces.long}:
                first, names = np.fromiter(new.values(), dtype=np.int64), list(new)
                part, ids, size = map(np.concatenate, zip(*self.merge(raw, at[first], lengths[first]), strict=True))
                none = np.zeros(len(part), dtype=np.uint64)
                self.pieces.put(none, none, ids, size, [names[k] for k in part.tolist()])
                found[longer] = [self.pieces.long[x] for x in own]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            a, b = low[missing], high[missing]
            by = np.lexsort((a, b))
            a, b = a[by], b[by]
            fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            first = missing[by[fresh]]
            part, ids, size = map(np.concatenate, zip(*self.merge(raw, at[first], lengths[first]), strict=True))
            n = self.pieces.put(low[first[part]], high[first[part]], ids, size)
            number = np.empty(len(part), dtype=np.int32)
            number[part] = np.arange(n, n + len(part))
            found[missing[by]] = number[np.cumsum(fresh) - 1]
        ids, size = self.pieces.use(found)
        ends = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=ends[1:])
        return ids, ends[of_text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.special.split(t) if self.special else [t] for t in texts]  # ordinary text and special tokens in turn
        flat, ends = self.encode_flat([x for own in parts for x in own[::2]])
        places = ends.tolist()
        out, at = [], 0
        for own in parts:
            n = len(own) // 2 + 1
            some = [flat[places[at + k] : places[at + k + 1]] for k in range(n)]
            at += n
            if n > 1:
                special = [np.array([self.added[x]], dtype=np.int32) for x in own[1::2]]
                some = [np.concatenate([x for both in zip(some, [*special, flat[:0]], strict=True) for x in both])]
            out.append(some[0])
        return out


_mergers: dict[str, Merger] = {}


def merger(key: str, model: dict) -> Merger:
    """One per worker process and vocabulary, for its cache."""
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(model)
    return _mergers[key]


def batches_of(texts: Iterable[str], most: int = 500_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, for bounded memory."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, *, text: str = "text", output: str = "ids") -> DataFrame:
    """All columns of docs, then ids (array<int>)."""
    columns = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), docs[text].cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path, shared.value)
        for b in batches:
            at = 0
            for some in batches_of(t.as_py() or "" for t in b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), lists(m.encode(some))], names=["_row", "_ids"])
                at += len(some)

    schema = rows.select("_row", F.array(F.lit(0)).alias("_ids")).schema
    return unpacked(rows.mapInArrow(run, schema), columns, {output: F.col("_ids")})


class Vocabulary:
    """The bytes of tokens in a row."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(x) for x in raw], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """The text of each run of ids, between one end and the next."""
        size = self.size[ids]
        place = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(place[-1])
        at += np.repeat(self.first[ids] - place[:-1], size)
        whole = self.bytes[at].tobytes()
        cuts = place[ends].tolist()
        return (whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def decode(tokens: DataFrame, path: str, *, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """All columns, then the decoded text; bytes that are not UTF-8 become the replacement character."""
    columns = tokens.columns
    rows = tokens.select(
        F.struct(*[tokens[f"`{c}`"] for c in columns]).alias("_row"),
        F.coalesce(tokens[ids].cast("array<int>"), F.array().cast("array<int>")).alias("_ids")
    )
    shared = tokens.sparkSession.sparkContext.broadcast(load(path)["raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for b in batches:
            own = b.column(1)
            ends = own.offsets.to_numpy().astype(np.int64)
            flat = own.values.to_numpy(zero_copy_only=False)
            k = 0
            while k < len(own):  # in runs of about so many ids, for bounded memory
                last = max(k + 1, int(np.searchsorted(ends, ends[k] + PART, side="right")) - 1)
                texts = list(vocabulary.texts(flat[ends[k] : ends[last]], ends[k : last + 1] - ends[k]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, last - k), pa.array(texts, pa.string())], names=["_row", "_out"])
                k = last

    schema = rows.select("_row", F.lit("").alias("_out")).schema
    return unpacked(rows.mapInArrow(run, schema), columns, {output: F.col("_out")})
