"""Packing by local search: the pieces of each document are whole, and places are those of a packing."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
import public_tokenizers

from coverlake.llm import binpack, word_bpe
from coverlake.llm.packing import best_fit
from coverlake.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ODD = [
    "", "It's DON'T 'S İstanbul ΣΑΣ ﬁ é éx <|endoftext|>abc<|startoftext|>", "a\x1cb \x85c\xa0d 12345 ½ ²³", "x" * 3000 + " " + "é" * 100,
    "日本語テキスト 한국어 각", "̀ͅa ̀", "A\x00b", "don''t ''s 's'S", "ǅ ǆ Ŀ ŉ ʼn ſ ẞ ß ɏ", "  \r\n\t ", "fi- 'LL we'll''ve", "\U0001f600 😀a1b2",
    "a" * 64 + "b " + "c" * 65, "naïve—“quoted” …"
]


def test_encoder_is_the_librarys():
    encoder = word_bpe.WordEncoder(word_bpe.load_words(PATH))
    for texts in (ODD, ODD[::-1], [" ".join(ODD)] * 2, []):
        flat, size = encoder.encode([t.encode() for t in texts])
        cuts = np.concatenate([[0], np.cumsum(size)]).astype(int)
        assert [flat[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [ids_of(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_encoder_on_any_text(texts):
    raw = [t.encode("utf-8", "replace") for t in texts]
    encoder = word_bpe.encoder(PATH, word_bpe.load_words(PATH) if PATH not in word_bpe._encoders else None)
    flat, size = encoder.encode(raw)
    cuts = np.concatenate([[0], np.cumsum(size)]).astype(int)
    assert [flat[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [ids_of(r.decode()) for r in raw]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(word_bpe, "CHUNKS", 50)
    encoder = word_bpe.WordEncoder(word_bpe.load_words(PATH))
    rng = random.Random(3)
    for _ in range(5):
        texts = [" ".join("".join(rng.choice("abcé'1") for _ in range(rng.randint(1, 20))) for _ in range(60)) for _ in range(3)]
        flat, size = encoder.encode([t.encode() for t in texts])
        assert flat.tolist() == [i for t in texts for i in ids_of(t)] and size.tolist() == [len(ids_of(t)) for t in texts]


def fewest(lengths, capacity):
    """By trying all."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                go(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_search_against_all_packings(lengths):
    bins = binpack.pack_block(lengths, 30)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 30 for b in bins)
    best = fewest(sorted(lengths, reverse=True), 30)
    assert best <= len(bins) <= best + 1 and len(bins) <= len(best_fit(lengths, 30))


def test_exchanges_empty_bins():
    # best fit decreasing leaves more bins than needed: each kind of exchange finds one of them
    assert len(best_fit([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 60)) == 4 and len(
        binpack.pack_block([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 60)
    ) == 3
    rng = random.Random(5)
    lengths = []
    for _ in range(700):
        a, b = rng.randint(500, 900), rng.randint(300, 700)
        lengths += [a, b, 2048 - a - b]
    before, after = len(best_fit(lengths, 2048)), len(binpack.pack_block(lengths, 2048))
    assert 700 <= after < before and (before - after) >= 0.2 * (before - 700)
    squares = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    assert squares(binpack.pack_block(lengths, 2048)) > squares([[i for i, _, _ in b] for b in best_fit(lengths, 2048)])


def held(rows, capacity=2048):
    """No two pieces overlap, and no sequence has a gap."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_query(spark, sf_dir):
    rows = QUERIES["op12_bin_packing"](spark, sf_dir).collect()
    docs = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == docs.keys()
    for d, own in pieces.items():
        ids = [*ids_of(docs[d]), 0]
        own.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [
            (k, 2048 * k, min(2048, len(ids) - 2048 * k)) for k in range(-(-len(ids) // 2048))
        ]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    total = sum(r["length"] for r in rows)
    assert held(rows) <= math.ceil(total / 2048) + 1


@pytest.mark.parametrize("block", [1 << 14, 40])
def test_edges(spark, block):
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "word " * 9000, "x" * 2500, *[" ".join(["tall"] * rng.randint(1, 60)) for _ in range(300)]]
    rows = [(None if k % 5 == 0 else k % 9, t, "e", "i", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, extra string, ids string, offset int")
    packed = binpack.pack_documents(docs, PATH, capacity=64, block=block).cache()
    assert packed.columns == ["doc_id", "extra", "piece", "start", "length", "ids", "sequence_id", "offset"]
    out = packed.collect()
    n, total = held(out, 64), sum(r["length"] for r in out)
    assert total == sum(len(ids_of(t)) + 1 for t in [*texts, *texts[:3]])
    assert n <= math.ceil(total / 64) * (1.02 if block > 40 else 1.1)
    # whole sequences: the ids of all pieces in their places
    own = {r["sequence_id"]: r for r in binpack.sequences(packed).collect()}
    for r in out:
        s = own[r["sequence_id"]]
        assert bytes(s["ids"])[4 * r["offset"] :][: 4 * r["length"]] == bytes(r["ids"]) and r["offset"] in s["cu_seqlens"]
    assert binpack.pack_documents(docs.limit(0), PATH).collect() == []
    again = binpack.pack_documents(docs.withColumn("text", F.col("text")), PATH, capacity=64, block=block).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, out), key=repr)
