"""Phrase collocations from merged count-min sketches and an exact last pass.

First passes, by length: words, then pairs, then phrases of three and four words. Each task counts the digests of its documents'
phrases, by language, in a count-min sketch; the sketches of all tasks are added up. A cell never counts less than any phrase
in it, so a phrase with a cell below the threshold is rare for certain, and so is every longer one that holds it: the next
sketch does not count these. Last pass: phrases that the merged sketches let through are counted exactly, as words, and those
below the threshold go. So nothing frequent is lost, and chance meetings in a sketch cost time only. Then each candidate is
scored at its weakest cut, and dropped where a longer one holds it and is nearly as frequent.

Scale: the cells of a sketch grow with the corpus, so that in the mean a fraction of the threshold meets in a cell, up to
``most_cells`` (a byte each in a task, a bit each in what is broadcast). In a corpus too large for these, more rare phrases pass
and are counted exactly in the shuffle, at worst all: results are the same. Sketches travel in slices of ``SLICE`` cells, which
are added where they meet. Only phrases of at least the threshold are joined with their parts and with what they hold. The
last ranking runs in slices of each language first. Tasks keep a bounded number of words and phrases and send on what is more.

Edge cases: null text is empty, null language is ``und``; texts of any length are taken whole; repeated rows count each; of
equal scores the more frequent phrase comes first, then the first in byte order, and of equal cuts the first; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

LONGEST = 4
#: The sketch that counts phrases of each length.
LEVEL = {1: 0, 2: 1, 3: 2, 4: 2}
LEVELS = 3
#: Numbers of what is no word, or none that counts.
END, RARE = -1, -2
#: A-Z to small letters, what ends a piece to a line break, a tab to a space.
SMALL = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that a task reads at once and in all, words and phrases that it keeps, about.
BATCH, TASK, WORDS, KEPT = 2 << 20, 64 << 20, 400_000, 2 << 20
#: Rows that a task sends on at once.
SENT = 1 << 16
#: Rows of a sketch, cells in a slice, what a cell counts to.
ROWS, SLICE, FULL = 2, 1 << 18, 255
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Words:
    """Texts of one language as numbers of words; a word keeps its number while the object lives."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.number: dict[bytes, int] = {b".": END}
        self.names: list[bytes] = []
        self.hash = np.empty(1 << 12, dtype=np.uint64)

    def read(self, texts: list[bytes], maps: list[np.ndarray], bits: int) -> np.ndarray:
        """The words of the texts in a row: numbers, RARE for those that the first map rules out, END where a piece ends and at the
        end."""
        # once the dots are line breaks no word has any
        tokens = b"\n".join([*texts, b""]).translate(SMALL).replace(b"\n", b" . ").split()
        number, names = self.number, self.names
        new = [w for w in dict.fromkeys(tokens) if w not in number]
        h = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in new), dtype=np.uint64, count=len(new))
        kept = passing(mixed(h), maps[0], bits) if maps else np.arange(len(new))
        first = len(names)
        for k in kept.tolist():
            number[new[k]] = len(names)
            names.append(new[k])
        while len(names) > len(self.hash):
            self.hash = np.concatenate([self.hash, np.empty_like(self.hash)])
        self.hash[first : len(names)] = h[kept]
        get = number.get
        return np.fromiter((get(w, RARE) for w in tokens), dtype=np.int64, count=len(tokens))

    def phrases(self, words: np.ndarray, maps: list[np.ndarray], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, where its phrases begin, their digests) for each length up to those of the level after the last map, but for
        phrases that a map rules out or whose parts one does."""
        own = self.hash[np.maximum(words, 0)]
        at = np.flatnonzero(words >= 0)
        h = own[at]
        left = np.zeros((LONGEST, len(words) + 1), dtype=bool)  # by length: places of phrases that are left
        for n in range(1, LONGEST + 1):
            level = LEVEL[n]
            if level > len(maps):
                return
            if n > 1:
                inside = left[n - 2][at + 1]  # the part without the first word is left too
                at = at[inside]
                h = mixed(h[inside] * ODD[1]) + own[at + n - 1]
            digests = mixed(h)
            if level < len(maps):
                ok = passing(digests, maps[level], bits)
                at, h, digests = at[ok], h[ok], digests[ok]
            left[n - 1][at] = True
            yield n, at, digests


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each digest in a row of 2**bits cells."""
    return (h * ODD[row] >> np.uint64(64 - bits)).astype(np.uint32)


def passing(h: np.ndarray, often: np.ndarray, bits: int) -> np.ndarray:
    """Which digests have cells that all count enough."""
    at = np.arange(len(h))
    for row in range(ROWS):
        c = cells(h[at], row, bits).astype(np.int64) + (row << bits)
        at = at[often[c >> 3] & (128 >> (c & 7)).astype(np.uint8) > 0]
    return at


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of about BATCH bytes, or one text."""
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = text.as_py()
            waiting.setdefault(lang, []).append(raw)
            size[lang] = size.get(lang, 0) + len(raw)
            if size[lang] >= BATCH:
                del size[lang]
                yield lang, waiting.pop(lang)
        if sum(size.values()) >= 4 * BATCH:  # many languages
            yield from waiting.items()
            waiting, size = {}, {}
    yield from waiting.items()


class Sketch:
    """Counts up to FULL in ROWS rows of 2**bits cells."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, np.zeros((ROWS, 1 << bits), dtype=np.uint8)

    def add(self, h: np.ndarray) -> None:
        for row in range(ROWS):
            at = np.sort(cells(h, row, self.bits))
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            at, n = at[first], np.diff(np.append(first, len(at)))
            own = self.count[row]
            own[at] = np.minimum(own[at] + n, FULL)

    def slices(self) -> Iterator[tuple[int, bytes]]:
        flat = self.count.reshape(-1)
        for k in range(0, len(flat), SLICE):
            part = flat[k : k + SLICE]
            if part.any():
                yield k // SLICE, pa.compress(part.tobytes(), "zstd", asbytes=True)


def sketch(texts: DataFrame, maps: list[np.ndarray], bits: int, least: int) -> np.ndarray:
    """texts: lang, text (binary). The merged sketch of the level after the maps: for each cell a bit that says whether it counts
    enough."""
    shared = texts.sparkSession.sparkContext.broadcast(maps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, langs, earlier = Sketch(bits), {}, shared.value
        for lang, some in by_lang(batches):
            words = langs.setdefault(lang, Words(lang))
            for n, _, h in words.phrases(words.read(some, earlier, bits), earlier, bits):
                if LEVEL[n] == len(earlier) and len(h):
                    own.add(h)
            if sum(len(w.names) for w in langs.values()) > WORDS:
                langs.clear()
        for k, part in own.slices():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int64()), "counts": pa.array([part], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = np.frombuffer(pa.decompress(part.as_py(), SLICE, "zstd"), dtype=np.uint8)
                total[k] = np.minimum(total[k].astype(np.uint16) + n, FULL).astype(np.uint8) if k in total else n
        for k, n in total.items():
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array([k], pa.int64()), "often": pa.array([np.packbits(n >= min(least, FULL)).tobytes()], pa.binary())}
            )

    often = np.zeros((ROWS << bits) // 8, dtype=np.uint8)
    merged = texts.mapInArrow(count, "slice long, counts binary").repartition("slice").mapInArrow(add, "slice long, often binary")
    for r in merged.collect():  # a bit for each cell: at most most_cells / 8 bytes
        often[r["slice"] * (SLICE // 8) : (r["slice"] + 1) * (SLICE // 8)] = np.frombuffer(r["often"], dtype=np.uint8)
    return often


def in_pairs(numbers: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of so many words as two numbers: of the first two words and of the others, 0 for none."""
    word = [numbers[at + k] + 1 if k < size else np.zeros(len(at), dtype=np.int64) for k in range(LONGEST)]
    return word[0] << 32 | word[1], word[2] << 32 | word[3]


def words_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The numbers of the words again, -1 for none."""
    return np.stack([left >> 32, left & 0xFFFFFFFF, right >> 32, right & 0xFFFFFFFF], axis=1) - 1


def added(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases with their numbers added up."""
    by = np.lexsort((right, left))
    left, right = left[by], right[by]
    first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    return left[first], right[first], np.add.reduceat(n[by], first)


def counted(texts: DataFrame, maps: list[np.ndarray], bits: int) -> DataFrame:
    """(lang, phrase, words, n) for the phrases that the sketches let through, and all words of a language with no phrase and
    0 words; of each task its own counts."""
    shared = texts.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        langs: dict[str, Words] = {}
        kept: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        single: dict[str, np.ndarray] = {}
        total: dict[str, int] = {}
        held = 0

        def together() -> int:
            """Add up what is kept; how many phrases that are."""
            for lang, own in kept.items():
                kept[lang] = [added(*map(np.concatenate, zip(*own, strict=True)))]
            return sum(len(own[0][0]) for own in kept.values())

        def rows(lang: str, phrases: list[bytes | None], size: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            texts = pa.array([x if x is None else x.decode("utf-8", "replace") for x in phrases], pa.string())
            return pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(phrases), pa.string()), "phrase": texts, "words": pa.array(size, pa.int32()),
                    "n": pa.array(n, pa.int64())
                }
            )

        def send() -> Iterator[pa.RecordBatch]:
            for lang, words in langs.items():
                names, n = words.names, single[lang]
                yield rows(lang, [None], np.zeros(1), np.array([total[lang]]))
                some = np.flatnonzero(n)
                for k in range(0, len(some), SENT):
                    part = some[k : k + SENT]
                    yield rows(lang, [names[w] for w in part.tolist()], np.ones(len(part)), n[part])
                for left, right, n in kept.get(lang, []):
                    for k in range(0, len(left), SENT):
                        sets = words_of(left[k : k + SENT], right[k : k + SENT])
                        yield rows(
                            lang, [b" ".join([names[w] for w in row if w >= 0]) for row in sets.tolist()], (sets >= 0).sum(axis=1),
                            n[k : k + SENT]
                        )

        for lang, some in by_lang(batches):
            words = langs.setdefault(lang, Words(lang))
            numbers = words.read(some, maps, bits)
            total[lang] = total.get(lang, 0) + int(np.count_nonzero(numbers != END))
            n = np.bincount(numbers[numbers >= 0], minlength=len(words.names))
            n[: len(single.get(lang, ()))] += single.get(lang, 0)
            single[lang] = n
            for size, at, _ in words.phrases(numbers, maps, bits):
                if size > 1 and len(at):
                    kept.setdefault(lang, []).append((*in_pairs(numbers, at, size), np.ones(len(at), dtype=np.int64)))
                    held += len(at)
            many = sum(len(w.names) for w in langs.values()) > WORDS
            if held >= KEPT or many:
                held = together()
                if many or 4 * held >= 3 * KEPT:
                    yield from send()
                    langs, kept, single, total, held = {}, {}, {}, {}, 0
        together()
        yield from send()

    return texts.mapInArrow(run, "lang string, phrase string, words int, n long")


def frequent(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, most_cells: int = 1 << 27) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of one to four words with f >= least, and for each language all its words as f of
    no phrase (null) with 0 words. Stored."""
    texts = docs.select(
        F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(docs[f"`{text}`"].cast("binary"), F.lit(b"")).alias("text")
    )
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    # what each task sends on is much the same, so tasks are few and large
    texts = texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TASK)))
    about = size // 6  # words; only the size of the sketches depends on it
    bits = max(18, min((4 * about // least).bit_length(), (most_cells // ROWS).bit_length() - 1))
    maps: list[np.ndarray] = []
    for _ in range(LEVELS):
        maps.append(sketch(texts, maps, bits, least))
    exact = counted(texts, maps, bits).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    return stored(exact.filter((F.col("f") >= least) | (F.col("words") == 0)))


def between(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("_words", first, count), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """phrases: what frequent() returns. (lang, phrase, words, a, l, r, score) of each with two words or more."""
    some = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("_words"))
    cuts = some.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "words", "a", "k", between(F.lit(1), F.col("k")).alias("_left"),
        between(F.col("k") + 1, F.col("words") - F.col("k")).alias("_right")
    )
    part = lambda name, f: phrases.filter("words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("_left", "l"), ["lang", "_left"]).join(part("_right", "r"), ["lang", "_right"])
    # a product of 2000000 and a count may pass 64 bits; the quotient does not
    score = F.expr(
        "(cast(a as decimal(28, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"
    )
    weakest = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))
    return weakest.select("lang", "phrase", "words", "a", "_cut.l", "_cut.r", F.col("_cut.score").cast("long").alias("score"))


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, nearly: int = 80,
    most_cells: int = 1 << 27
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a (its count), l, r (those of its parts at the weakest cut), n
    (all words of the language), score. A phrase goes if a longer one that holds it has ``nearly`` percent of its count."""
    phrases = frequent(docs, text=text, lang=lang, least=least, most_cells=most_cells)
    longer = phrases.filter("words > 2").select("lang", "f", F.split("phrase", " ").alias("_words"), "words")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: between(i, n))
        )
    )
    holders = longer.select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("_held"))
    wide = lambda c: F.col(c).cast("decimal(20, 0)")
    left = scored(phrases).join(holders, ["lang", "phrase"], "left").filter(
        F.coalesce(wide("_held") * 100 < wide("a") * nearly, F.lit(True))
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    first = salted.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = phrases.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
