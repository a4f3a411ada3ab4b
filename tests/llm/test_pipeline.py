"""The pipeline's stages one after the other, each on its predecessor's rows, against plain versions."""

from collections import Counter

import brute
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

COLUMNS = cp.COLUMNS


def grams(text, size=5):
    w = brute.WORD.findall(brute.low(text))
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} or {" ".join(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    long = " ".join(f"word{k % 977}x{k % 13}" for k in range(3000))
    secret = "Here is a note that keeps to the rules and then says password = abcdef123456ghij for all to see, which nobody should do at any time."
    edge = [
        (None, long, "en", None, 1), (None, long, "en", None, 1), (900001, None, "en", "a", 0), (900002, "", None, "", None),
        (900003, secret, "en", "src1", len(secret)), (900003, secret, "en", "src1", len(secret)), (None, secret + " End.", None, None, None)
    ]
    rows = docs.unionByName(spark.createDataFrame(edge, docs.schema))
    out = [rows.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
        if k < 4:
            assert rows.columns == COLUMNS
        out.append(rows.collect())
    return out


def test_quality(stages):
    before, after = stages[0], stages[1]
    assert not Counter(map(tuple, after)) - Counter(map(tuple, before))
    for r in after:
        n, _, _, _, repeats = brute.statistics(r["text"])
        assert n >= 20 and 100 * repeats <= 30 * n
    plain = [
        r for r in before
        if not any(c in (r["text"] or "") for c in "#*$%&|<>") and (s := brute.statistics(r["text"]))[0] >= 20 and 100 * s[4] <= 30 * s[0]
    ]
    assert not Counter(map(tuple, plain)) - Counter(map(tuple, after))


def test_near_duplicates(stages):
    before, after = stages[1], stages[2]
    sets = [grams(r["text"]) for r in before]
    kept = Counter(map(tuple, after))
    assert not kept - Counter(map(tuple, before)) and max(kept.values()) == 1
    # of each group linked by a similarity of 0.8 or more one text stays, whatever copies of it there are; all others stay
    label = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large and label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for x, r in zip(label, before, strict=True):
        groups.setdefault(x, []).append(r)
    assert len(groups) < len(before)
    left = Counter(map(tuple, after))
    for group in groups.values():
        first = min(group, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
        assert sum(left[x] for x in set(map(tuple, group))) == 1 and tuple(first) in left
    assert sum(left.values()) == len(groups)


def test_secrets(stages):
    before, after = {r["doc_id"]: r for r in stages[2]}, stages[3]
    assert len(after) == len(stages[2])
    for r in after:
        old = before[r["doc_id"]]["text"]
        assert "abcdef123456ghij" not in r["text"]
        if "[SECRET]" not in r["text"]:
            assert r["text"] == old and r["n_chars"] == before[r["doc_id"]]["n_chars"]
        else:
            assert r["n_chars"] == len(r["text"]) and brute.spans(old)


def test_mixing(stages):
    before, after = stages[3], stages[4]
    times = Counter(map(tuple, after))
    assert not set(times) - set(map(tuple, before)) and max(times.values()) <= 3
    size, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        n = len(brute.WORD.findall(r["text"]))
        size[r["source"]] += n
        taken[r["source"]] += n * times[tuple(r)]
        largest[r["source"]] = max(largest[r["source"]], n)
    for s, t in brute.targets(size).items():
        assert abs(taken[s] - t) <= 2 * largest[s]


def test_tokens(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], tuple(t.encode(r["text"], add_special_tokens=False).ids)) for r in stages[4])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages[5]) == want


def test_clashing_columns(spark, sf_dir):
    """Columns beyond those of documents go at the first stage, whatever their names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    names = ["_row", "_text", "_key", "_id", "_n", "_md5", "_fp", "kept", "spans", "size", "ids", "key", "component_id"]
    more = docs.withColumns({c: docs["text"] for c in names})
    for _, stage in cp.STAGES[:-1]:
        plain, clash = stage(spark, docs, sf_dir), stage(spark, more, sf_dir)
        assert clash.columns == COLUMNS
        assert sorted(map(repr, clash.collect())) == sorted(map(repr, plain.collect()))


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []
