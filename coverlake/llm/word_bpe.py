"""Byte-level BPE with word ends, for vocabularies that drop white space and lower-case letters.

White space cuts a text before anything else does, so the ids of a text are those of its chunks in a row, and a chunk's ids
depend on the chunk alone. Each worker remembers chunks and the words within; new words are merged side by side by the segment
trees of ``bpe``, where the last byte of a word starts as a symbol of its own. Chunks outside the Latin letters (whose
normal forms and small letters follow longer rules), long words and the strings of special tokens go to the tokenizers
library.

Scale: a map over batches; of more than ``CHUNKS`` chunks a worker keeps the more used half. What is broadcast is the
vocabulary, which is fixed.

Edge cases: null text is empty and has no ids; texts of any length are encoded whole; equal texts have equal ids.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from tokenizers import Tokenizer

from .bpe import LOW, ROWS, SIDE_BY_SIDE, Merger, Remembered, byte_names, load

#: Fixed values of this kind of vocabulary: how a chunk is cut into words, and the mark of a word's end.
WORDS = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
END = "</w>"
#: Chunks that a worker remembers.
CHUNKS = 1_000_000
#: Letters below here are composed already and have their small letters one by one, but for one.
LATIN, DOTTED = "ɐ", "İ"
#: Bytes that are not white space.
INK = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def load_words(path: str) -> dict:
    """The arrays of load(), with 256 more symbols for bytes that end a word, and the file itself."""
    with open(path, encoding="utf-8") as f:
        whole = f.read()
    model, vocab = load(path), json.loads(whole)["model"]["vocab"]
    last = np.zeros(256, dtype=np.int32)
    for c, b in byte_names().items():
        last[b] = vocab[c + END]
    return {
        "first": np.concatenate([model["first"], last]), "keys": model["keys"], "ranks": model["ranks"], "made": model["made"],
        "added": model["added"], "json": whole
    }


class Pool:
    """Runs of ids by number, in one array that grows."""

    def __init__(self) -> None:
        self.ids, self.used = np.empty(1 << 16, dtype=np.int32), 0
        self.first, self.size, self.count = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int32), 0

    def put(self, ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.count + len(size) > len(self.size):
            self.first, self.size = np.concatenate(
                [self.first, np.empty_like(self.first)]
            ), np.concatenate([self.size, np.empty_like(self.size)])
        ends = np.cumsum(size, dtype=np.int64) + self.used
        self.first[self.count : self.count + len(size)] = ends - size
        self.size[self.count : self.count + len(size)] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.count = self.used + len(ids), self.count + len(size)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs in a row, and how many each has."""
        size = self.size[numbers]
        ends = np.cumsum(size, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.first[numbers] - (ends - size), size)
        return self.ids[at], size


class WordEncoder:
    """Encodes texts with what load_words() returns."""

    def __init__(self, model: dict):
        self.merger = Merger(model)
        self.whole = Tokenizer.from_str(model["json"])
        self.special = sorted(model["added"])
        self.chunks = Remembered(CHUNKS)
        self.forget_words()

    def forget_words(self) -> None:
        self.words: dict[str, int] = {}
        self.of_words = Pool()

    def odd(self, chunk: str) -> bool:
        return max(chunk) >= LATIN or DOTTED in chunk or "<|" in chunk and any(s in chunk for s in self.special)

    def by_library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.whole.encode_batch(texts, add_special_tokens=False)]

    def learn_words(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        short = [k for k, w in enumerate(raw) if len(w) <= SIDE_BY_SIDE]
        ids: list = [None] * len(new)
        codes = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int16)
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(lengths)
        codes[ends - 1] += 256
        order = np.array(short, dtype=np.int64)
        width = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(lengths[order], 1))).astype(np.int64))
        for w in np.unique(width).tolist():
            mine = order[width == w]
            for k in range(0, len(mine), ROWS):
                part = mine[k : k + ROWS]
                flat, size = self.merger.side_by_side(codes, ends[part] - lengths[part], lengths[part], w)
                cuts = np.cumsum(size, dtype=np.int64)
                for p, a, b in zip(part.tolist(), (cuts - size).tolist(), cuts.tolist(), strict=True):
                    ids[p] = flat[a:b]
        for k in set(range(len(new))).difference(short):
            ids[k] = np.array(self.by_library([new[k]])[0], dtype=np.int32)
        self.words.update(zip(new, range(self.of_words.count, self.of_words.count + len(new)), strict=True))
        self.of_words.put(np.concatenate(ids), np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)))

    def of_new(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these chunks in a row, and how many each has."""
        texts = [c.decode("utf-8", "replace") for c in new]
        odd = [k for k, t in enumerate(texts) if self.odd(t)]
        by_library = self.by_library([texts[k] for k in odd])
        for k in odd:
            texts[k] = ""
        if len(self.words) > CHUNKS:
            self.forget_words()
        # chunks hold no line break, so it marks where one ends
        parts = WORDS.findall("\n".join(texts).lower() + "\n")
        unseen = list(dict.fromkeys(p for p in parts if p not in self.words and p != "\n"))
        if unseen:
            self.learn_words(unseen)
        breaks = np.fromiter((p == "\n" for p in parts), dtype=bool, count=len(parts))
        words = self.words
        flat, size = self.of_words.take(np.fromiter((words[p] for p in parts if p != "\n"), dtype=np.int64))
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(~breaks)[breaks]]
        size = np.diff(upto, prepend=0)
        if odd:
            own = np.split(flat, upto[:-1])
            for k, ids in zip(odd, by_library, strict=True):
                own[k], size[k] = np.array(ids, dtype=np.int32), len(ids)
            flat = np.concatenate(own)
        return flat, size.astype(np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (UTF-8) in a row, and how many each has."""
        whole = b" ".join(texts)
        raw = np.frombuffer(whole + bytes(16), dtype=np.uint8)
        ink = np.zeros(len(whole) + 2, dtype=bool)
        ink[1:-1] = INK[raw[: len(whole)]]
        at, ends = np.flatnonzero(ink[1:] & ~ink[:-1]), np.flatnonzero(ink[:-1] & ~ink[1:])
        lengths = ends - at
        words = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
        low, high = words[at] & LOW[np.minimum(lengths, 8)], words[at + 8] & LOW[np.clip(lengths - 8, 0, 7)]
        high |= lengths.astype(np.uint64) << np.uint64(56)
        self.chunks.trim()
        found = self.chunks.find(low, high)
        longer = np.flatnonzero(lengths > 15)
        if len(longer):
            own = [whole[a:b] for a, b in zip(at[longer].tolist(), ends[longer].tolist(), strict=True)]
            get = self.chunks.long.get
            if new := list(dict.fromkeys(x for x in own if get(x) is None)):
                none = np.zeros(len(new), dtype=np.uint64)
                self.chunks.put(none, none, *self.of_new(new), new)
            found[longer] = [get(x) for x in own]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            a, b = low[missing], high[missing]
            by = np.lexsort((a, b))
            a, b = a[by], b[by]
            fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            first = missing[by[fresh]]
            n = self.chunks.put(
                low[first], high[first], *self.of_new([whole[x:y] for x, y in zip(at[first].tolist(), ends[first].tolist(), strict=True)])
            )
            found[missing[by]] = n + np.cumsum(fresh) - 1
        flat, size = self.chunks.use(found)
        # a text's chunks are those that begin before its end
        text_ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.searchsorted(at, text_ends)]
        return flat, np.diff(upto, prepend=0)


_encoders: dict[str, WordEncoder] = {}


def encoder(key: str, model: dict) -> WordEncoder:
    """One per worker process and vocabulary, for what it remembers."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(model)
    return _encoders[key]
