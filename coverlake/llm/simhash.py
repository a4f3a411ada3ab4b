"""SimHash near-duplicates by tiled exact comparison.

A fingerprint is the bitwise majority of the digests of a text's word shingles. Equal fingerprints are merged first; then
fingerprints within the radius are linked, and documents reachable by links form a component.

Fingerprints meet in blocks. With a radius of two bits of 64, two fingerprints agree in at least two of four sixteen-bit
quarters, so six blocks each, one for each pair of quarters, hold every link. With a similarity instead (0.8 of five-word
shingles, say), fingerprints are those of the set of shingles, have 256 bits and are followed by a digest of that set, and the
radius is a number of bits that texts of that similarity practically never exceed; as no choice of bits is then sure to agree,
blocks are pairs of least digests of the shingles, which such texts share in at least one of sixteen with all but one in ten
million. Within a block every fingerprint is compared with every other. What is within the radius is only a candidate pair, kept
in the first block that both share: the sets of shingles of such pairs meet once more, and pairs are linked whose Jaccard
similarity, counted out, suffices. Texts that are candidates of none are not read again.

A block is cut into tiles in order of bit totals; pairs of tiles are compared in full with exclusive-or and bit counts. Tiles
whose bit totals differ by more than the radius are never dealt to a task together, and within a pair parts that far apart are
skipped. A pair of tiles returns a spanning star for each group it connects, and the stars are joined over the corpus.

Scale: blocks have 2^32 keys and more each, so a block stays small while the corpus grows; one that does not (a large group
of near copies) is spread over its pairs of tiles of at most about ``tile`` fingerprints. No task holds more than two tiles.
Candidate pairs are dealt by runs of members of at most ``SHINGLES`` shingles, so that work and copies of texts follow the
pairs, not the groups that they would chain into.
Links, components and fingerprints stay in DataFrames. A fingerprint that many rows carry meets them in several places.

Edge cases: null and empty texts have fingerprint zero and link like any other; a text with fewer words than a shingle is one
shingle; repeated rows and repeated ids link through their fingerprint; the component of rows without any id is null; an
empty table gives an empty table; input columns named ``fingerprint`` or ``component_id`` give way to the results. A bit that is
set in just half of the digests is 0; texts of any length are cut into shingles whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined_back, stored, unpacked

SEED = 42
#: Digests handled at once.
PART = 65536
#: Places over which the nodes of one component are dealt.
SALTS = 32
#: Shingles in a tile of candidates, about.
SHINGLES = 1 << 20
#: Words of 64 bits in a fingerprint of a set of shingles.
WORDS = 4
QUARTERS = (0xFFFF, 0xFFFF << 16, 0xFFFF << 32, 0xFFFF << 48)


def shingles(text: str | None, size: int) -> list[str]:
    # bytes.lower changes A-Z only, and bytes.split cuts at space and 9-13 only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*[words[k:] for k in range(size)])]


def majority(hashes: np.ndarray, words: int = 1) -> bytes:
    """Bits that are set in over half of the digests, big-endian; further words of 64 bits come from the digests mixed again."""
    out = []
    for k in range(words):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), PART):  # in parts, for bounded memory
            part = mixed(hashes[at : at + PART], k)
            counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits((2 * counts > len(hashes)).astype(np.uint8)).tobytes())
    return b"".join(out)


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The digests themselves for 0, else other digests of them."""
    if not k:
        return hashes
    x = (hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def digests(text: str | None, size: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in shingles(text, size)), dtype=np.uint64)


#: For blocks by shared shingles: so many blocks a text, each named by so many least digests.
BANDS, ROWS = 16, 2
_salts = np.array([k * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019 & (1 << 64) - 1 for k in range(1, BANDS * ROWS + 1)], dtype=np.uint64)


def least_digests(hashes: np.ndarray) -> list[int]:
    """A key for each of the BANDS blocks."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), PART // 8):
        x = (hashes[at : at + PART // 8, None] ^ _salts) * np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, (x ^ x >> np.uint64(31)).min(axis=0), out=low)
    pairs = low.reshape(BANDS, ROWS)
    return (pairs[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ pairs[:, 1]).view(np.int64).tolist()


def differing(common: int, left: int, right: int) -> float:
    """Chance that a bit differs between sets that have so many shingles in common and so many of their own."""
    out = 0
    for k in range(common + 1):
        a = sum(comb(left, x) for x in range(left + 1) if 2 * (k + x) > common + left)
        b = sum(comb(right, y) for y in range(right + 1) if 2 * (k + y) > common + right)
        out += comb(common, k) * (a * (2**right - b) + (2**left - a) * b)
    return out / 2 ** (common + left + right)


def radius_of(similarity: float, bits: int, small: int = 24) -> int:
    """Bits by which sets of at least this Jaccard similarity practically never differ more: the mean and five deviations,
    of large sets by the angle between them, of small ones, whose ties raise it, by counting."""
    p = [np.arccos(2 * similarity / (1 + similarity)) / np.pi]
    for n in range(2, small + 1):
        p += [differing(c, x, n - c - x) for c in range(1, n) if c / n >= similarity for x in range((n - c) // 2 + 1)]
    return int(min(bits, bits * max(p) + 5 * np.sqrt(bits * max(p) * (1 - max(p)))))


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, sets: bool = False) -> DataFrame:
    """The columns of docs but for the text, then _fp (binary). Of sets also the text again, _at (a number for each row),
    _keys (names of blocks by shared shingles) and _shingles (how many)."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(
        *[docs[f"`{c}`"] for c in rest], F.lit(b"").alias("_fp"),
        *(
            [
                docs[f"`{text}`"], F.lit(0).cast("long").alias("_at"), F.array(F.lit(0).cast("long")).alias("_keys"),
                F.lit(0).cast("long").alias("_shingles")
            ]
            if sets else []
        )
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        for b in batches:
            fps, keys, sizes = [], [], []
            for t in b.column(text):
                h = digests(t.as_py(), size)
                if sets:
                    h = np.unique(h)
                    fps.append(majority(h, WORDS) + xxhash.xxh3_128_digest(h.tobytes(), SEED))
                    keys.append(least_digests(h))
                    sizes.append(len(h))
                else:
                    fps.append(majority(h))
            more = [
                b.column(text), pa.array(made + np.arange(len(fps))), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())
            ] if sets else []
            made += len(fps)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(fps, pa.binary()), *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def bits(x: np.ndarray) -> np.ndarray:
    """x: (..., words)."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def compare(left: np.ndarray, right: np.ndarray, radius: int, part: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within the radius; left and right: (n, words). Both sides are ordered by bit count, so that
    parts too far apart are skipped."""
    lc, rc = bits(left), bits(right)
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    ls, rs, lc, rc = left[lo], right[ro], lc[lo], rc[ro]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(ls), part):
        x = ls[a : a + part]
        for b in range(0, len(rs), part):
            y = rs[b : b + part]
            if rc[b] - lc[a + len(x) - 1] > radius or lc[a] - rc[b + len(y) - 1] > radius:
                continue
            apart = np.zeros((len(x), len(y)), dtype=np.uint16)
            for w in range(x.shape[1]):
                apart += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
            i, j = np.nonzero(apart <= radius)
            out.append((lo[a + i], ro[b + j]))
    if not out:
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def stars(values: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of so many values the smallest index that the links i-j connect it to."""
    label = np.arange(values)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def quarters(fps: DataFrame) -> DataFrame:
    """fp (binary of 8 bytes) in its six blocks: exact for a radius of two bits."""
    value = F.conv(F.hex("fp"), 16, -10).cast("long")
    mask: Column = F.array(*[F.lit(np.uint64(QUARTERS[p] | QUARTERS[q]).astype(np.int64).item()) for p, q in combinations(range(4), 2)])
    return fps.select(
        "fp", value.alias("_value"), F.posexplode(mask).alias("_block", "_mask")
    ).select("fp", "_block", F.col("_value").bitwiseAND(F.col("_mask")).alias("_key"))


def bit_total(fp: str, words: int) -> Column:
    """Set bits among the first words of 64 bits of fp (binary)."""
    return sum(
        (F.bit_count(F.conv(F.substring(F.hex(fp), 16 * k + 1, 16), 16, -10).cast("long")) for k in range(words)), F.lit(0)
    ).cast("int")


def in_tiles(blocks: DataFrame, radius: int, tile: int = 1024, words: int = 1) -> DataFrame:
    """blocks: fp, _block, _key, distinct, and any other columns. Members of blocks with two or more, with _tile and _others.

    The members of a block stand in order of their bit totals, and each run of about ``tile`` of them is a tile. A member goes
    to the tiles that hold a total within the radius of its own.
    """
    # only blocks with two members have pairs; a block has at most one entry in _totals for each bit total
    counted = blocks.select("*", bit_total("fp", words).alias("_total"))
    parts = counted.groupBy("_block", "_key", "_total").agg(F.count("*").alias("_n"))
    sizes = parts.groupBy("_block", "_key").agg(
        F.sum("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_total", "_n"))).alias("_totals")
    ).filter("_n > 1")
    before = lambda p: F.aggregate(
        F.filter("_totals", lambda q: q["_total"] < p["_total"]), F.lit(0).cast("long"), lambda s, q: s + q["_n"]
    )
    runs = F.transform("_totals", lambda p: F.struct(p["_total"].alias("total"), before(p).alias("first"), p["_n"].alias("n")))
    sizes = sizes.select("_block", "_key", F.when(F.col("_n") > tile, runs).alias("_runs"))
    own = F.filter("_runs", lambda r: r["total"] == F.col("_total"))[0]
    near = F.filter("_runs", lambda r: F.abs(r["total"] - F.col("_total")) <= radius)
    of = lambda place: F.floor(place / tile).cast("long")
    others = F.sequence(of(near[0]["first"]), of(F.element_at(near, -1)["first"] + F.element_at(near, -1)["n"] - 1))
    zero = F.lit(0).cast("long")
    return counted.join(sizes, ["_block", "_key"]).select(
        *blocks.columns, F.coalesce(of(own["first"] + F.pmod(F.xxhash64("fp"), own["n"])), zero).alias("_tile"),
        F.coalesce(others, F.array(zero)).alias("_others")
    )


def links(blocks: DataFrame, radius: int, tile: int = 1024) -> DataFrame:
    """blocks: fp, _block, _key, distinct. Edges (a, b): within their blocks, stars over all groups linked by the radius."""
    return tiled(in_tiles(blocks, radius, tile), radius)


def runs_of(sizes: np.ndarray, most: int) -> np.ndarray:
    """A number for each member: runs whose sizes add up to so much, or single members."""
    upto = np.cumsum(sizes)
    out, k, start = np.empty(len(sizes), dtype=np.int64), 0, 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
        out[start:end] = k
        start, k = end, k + 1
    return out


def verified(placed: DataFrame, sets: DataFrame, radius: int, similarity: float, size: int) -> DataFrame:
    """placed: fp, _block, _key, _tile, _others, _at, _keys, _shingles. sets: _at, _text. Edges (a, b): stars over all that a
    candidate pair links, in whose first common block they meet.
    """
    value = F.struct("fp", "_at", "_keys", "_shingles")
    pairs = met(placed, value, ["_block", "_key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        for b in batches:
            for block, lc, rc in zip(b.column("_block").to_pylist(), b.column("left"), b.column("right"), strict=True):
                lv, rv = lc.as_py(), rc.as_py()
                values = lv + rv
                fps = words_of([x["fp"] for x in values])
                i, j = compare(fps[: len(lv)], fps[len(lv) :] if rv else fps, radius)
                j = j + (len(lv) if rv else 0)
                i, j = i[i < j], j[i < j]
                keys = np.array([x["_keys"] for x in values])
                for earlier in keys.T[:block]:
                    apart = earlier[i] != earlier[j]
                    i, j = i[apart], j[apart]
                if not len(i):
                    continue
                run = runs_of(np.array([x["_shingles"] for x in values]), SHINGLES)
                both = np.sort(np.stack([run[i], run[j]], axis=1), axis=1)
                for k in np.unique(both, axis=0):
                    own = (both == k).all(axis=1)
                    members = np.unique(np.concatenate([i[own], j[own]]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([made] * len(members), pa.int64()), pa.array([values[x]["fp"] for x in members], pa.binary()),
                            pa.array([values[x]["_at"] for x in members], pa.int64())
                        ],
                        names=["_group", "fp", "_at"]
                    )
                    made += 1

    groups = stored(pairs.mapInArrow(find, "_group long, fp binary, _at long"))
    texts = groups.join(sets, "_at").select("_group", "fp", "_text")
    schema = texts.select("_group", "fp", F.lit(b"").alias("_set")).schema

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(digests(t.as_py(), size)).tobytes() for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_group"), b.column("fp"), pa.array(own, pa.binary())], names=schema.names)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in b.column("members"):
                values = sorted((x["fp"], x["_set"]) for x in own.as_py())
                names = [x for x, _ in values]
                fps = words_of(names)
                i, j = compare(fps, fps, radius)
                i, j = i[i < j], j[i < j]
                yield star_edges(names, *similar([np.frombuffer(x, dtype=np.uint64) for _, x in values], i, j, similarity))

    members = texts.mapInArrow(digest, schema).groupBy("_group").agg(
        F.collect_list(F.struct("fp", "_set")).alias("members")
    ).select("members")
    return one_each(members.mapInArrow(link, "a binary, b binary").distinct())


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs i-j of sets of distinct digests, some with at least this Jaccard similarity that connect all that such pairs
    connect: pairs of sets that are connected already are not counted."""
    sizes = np.array([len(x) for x in sets])
    most = np.maximum(sizes[i], sizes[j])
    at = np.flatnonzero((np.minimum(sizes[i], sizes[j]) >= similarity * most * (1 - 1e-9)) & (most > 0))
    at = at[np.argsort(i[at], kind="stable")]
    if not len(at):
        return i[:0], j[:0]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    seen = np.zeros(len(ids), dtype=bool)
    above = list(range(len(sets)))

    def head(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    left, right = [], []
    for some in np.split(at, np.flatnonzero(np.diff(i[at])) + 1):
        one = int(i[some[0]])
        own = ids[first[one] : first[one] + sizes[one]]
        seen[own] = True
        for o in j[some].tolist():
            a, b = head(one), head(o)
            if a == b:
                continue
            common = np.count_nonzero(seen[ids[first[o] : first[o] + sizes[o]]])
            if common / (sizes[one] + sizes[o] - common) >= similarity:
                above[max(a, b)] = min(a, b)
                left.append(one)
                right.append(o)
        seen[own] = False
    return np.array(left, dtype=int), np.array(right, dtype=int)


def words_of(fps: list[bytes]) -> np.ndarray:
    """Fingerprints as numbers: (n, words)."""
    return np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64).reshape(len(fps), -1)[:, :WORDS]


def star_edges(names: list[bytes], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Edges from each member (names in ascending order) to the least that the links i-j connect it to, so that the stars of one
    group mostly agree on their centre."""
    label = stars(len(names), i, j)
    own = np.flatnonzero(label != np.arange(len(names)))
    return pa.RecordBatch.from_arrays(
        [pa.array([names[k] for k in own], pa.binary()), pa.array([names[label[k]] for k in own], pa.binary())], names=["a", "b"]
    )


def met(member: DataFrame, value: Column, block: list[str]) -> DataFrame:
    """member: the columns of its block, _tile and _others (the tiles that it meets, its own too). For each pair of tiles that
    meet: the block, left and right (arrays of values; no right for a tile and itself)."""
    dealt = member.select(value.alias("_value"), *block, "_tile", F.explode("_others").alias("_other")).select(
        "_value", *block, "_tile", F.least("_tile", "_other").alias("_i"), F.greatest("_tile", "_other").alias("_j")
    )
    left = F.collect_list(F.when(F.col("_tile") == F.col("_i"), F.col("_value"))).alias("left")
    right = F.collect_list(F.when(F.col("_tile") != F.col("_i"), F.col("_value"))).alias("right")
    return dealt.groupBy(*block, "_i", "_j").agg(left, right).select(*block, "left", "right")


def tiled(member: DataFrame, radius: int) -> DataFrame:
    """member: fp, _block, _key, _tile, _others. Edges (a, b) between members of a block."""
    pairs = met(member, F.col("fp"), ["_block", "_key"]).select("left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lc, rc in zip(b.column("left"), b.column("right"), strict=True):
                lv, rv = lc.as_py(), rc.as_py()
                values = lv + rv
                fps = words_of(values)
                # within one tile against itself; of two tiles only across, as each is compared with itself elsewhere
                i, j = compare(fps[: len(lv)], fps[len(lv) :] if rv else fps, radius)
                j = j + (len(lv) if rv else 0)
                by = sorted(range(len(values)), key=values.__getitem__)
                rank = np.empty(len(values), dtype=int)
                rank[by] = np.arange(len(values))
                yield star_edges([values[k] for k in by], rank[i], rank[j])

    return one_each(pairs.mapInArrow(run, "a binary, b binary").distinct())


def one_each(edges: DataFrame) -> DataFrame:
    """edges: (a, b), b the lesser. The same components with about one edge for each a: to the least b, which the other b
    are then joined to."""
    least = edges.select("b", "a", F.min("b").over(W.partitionBy("a")).alias("_least"))
    return least.select(
        F.explode(
            F.array(F.struct("a", F.col("_least").alias("b")), F.struct(F.col("b").alias("a"), F.col("_least").alias("b")))
        ).alias("e")
    ).select("e.a", "e.b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b): equal labels where connected.

    Each round gives a node the least label beside it, then that label's own label; path lengths about halve each time. Most
    nodes of a large component carry its star's centre; such hot nodes meet their rows in several places.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    degree = stored(both.groupBy("b").agg(F.count("*").alias("_n")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = joined_back(both, labels.withColumnRenamed("node", "b"), "b", degree).groupBy("a").agg(F.min("label").alias("_near"))
        low = stored(
            labels.join(near, labels["node"] == near["a"]).select(
                "node", F.col("label").alias("_was"), F.least("label", "_near").alias("_low")
            )
        )
        jump = labels.select(F.col("node").alias("_low"), F.col("label").alias("_next"))
        after = joined_back(low, jump, "_low", low.groupBy("_low").agg(F.count("*").alias("_n")))
        after = stored(after.select("node", "_was", F.least("_low", "_next").alias("label")))
        moved = after.filter("_was <> label").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels


def beside(groups: DataFrame, totals: DataFrame) -> DataFrame:
    """groups (node, label, ...) with the columns of totals, which has one row for each label."""
    # a component may hold a third of all fingerprints: its nodes meet their totals in several places
    spread = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = groups.select("*", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("_salt"))
    return salted.join(spread, ["label", "_salt"]).drop("_salt")


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, similarity: float | None = None, tile: int = 1024
) -> DataFrame:
    """The columns of docs but for the text, then fingerprint (hex digits) and component_id (the least key reachable).

    Links: at most two of 64 bits, or texts whose sets of shingles have at least the given Jaccard similarity.
    """
    columns = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), docs[key].alias("_id"), docs[text].alias("_text"))
    marked = stored(fingerprints(rows, "_text", size, similarity is not None))
    if similarity is None:
        distinct = stored(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("_least"), F.count("*").alias("_n")))
        edges = links(quarters(distinct.select("fp")), 2, tile)
    else:
        distinct = stored(
            marked.groupBy(F.col("_fp").alias("fp")).agg(
                F.min("_id").alias("_least"), F.count("*").alias("_n"), F.min(F.struct("_at", "_keys", "_shingles")).alias("_one")
            )
        )
        radius = radius_of(similarity, 64 * WORDS)
        blocks = distinct.select("fp", "_one.*", F.posexplode("_one._keys").alias("_block", "_key"))
        edges = verified(in_tiles(blocks, radius, tile, WORDS), marked.select("_at", "_text"), radius, similarity, size)
    labels = components(edges)
    groups = labels.join(distinct, labels["node"] == distinct["fp"]).select("node", "label", "_least")
    reach = beside(groups, groups.groupBy("label").agg(F.min("_least").alias("_reach"))).select(F.col("node").alias("fp"), "_reach")
    final = distinct.join(reach, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("_reach", "_least").alias("_component"))
    shown = F.substring(F.lower(F.hex("_fp")), 1, 16 * (1 if similarity is None else WORDS))
    back = joined_back(marked.select("_row", "_fp"), final, "_fp", distinct.select(F.col("fp").alias("_fp"), "_n"))
    return unpacked(back, columns, {"fingerprint": shown, "component_id": F.col("_component")})
