"""The registered queries over the smallest tables, held against plain versions."""

import re
import zlib

import brute
import duckdb
import pytest

from coverlake.llm import audio
from coverlake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(sf_dir):
    return {r[0]: r for r in duckdb.sql(f"select doc_id, text, source from '{sf_dir}/documents.parquet'").fetchall()}


def rows(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def test_mixing(spark, sf_dir, docs):
    out = rows(spark, sf_dir, "op1_mix_sources")
    assert len(out) == len(docs)
    sizes = {}
    for d, t, s in docs.values():
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want, taken, biggest = brute.targets(sizes), {}, {}
    for r in out:
        assert r["size"] == len(brute.WORD.findall(docs[r["doc_id"]][1] or ""))
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        biggest[r["source"]] = max(biggest.get(r["source"], 0), r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * biggest[s]
    assert sorted(map(tuple, out)) == sorted(map(tuple, rows(spark, sf_dir, "op1_mix_sources")))


def test_scores(spark, sf_dir, docs):
    out = {r["doc_id"]: r for r in rows(spark, sf_dir, "op2_lm_score")}
    order = sorted(docs)
    base = brute.unigram([(d, docs[d][1]) for d in order])
    train = [docs[d][1] for d in order if zlib.crc32(str(d).encode()) % 10]
    model = brute.Ppm(train, 5)
    for d, b in zip(order, base, strict=True):
        r = out[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == b[:3]
        assert r["base_score"] == pytest.approx(b[3], rel=1e-9)
    for d in order[::7]:
        assert out[d]["score"] == pytest.approx(model.score(docs[d][1]), rel=1e-9)


def test_secrets(spark, sf_dir, docs):
    out = rows(spark, sf_dir, "op3_secret_scan")
    assert len(out) == len(docs)
    for r in out:
        want = brute.spans(docs[r["doc_id"]][1])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == brute.sha(listed)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_html(spark, sf_dir):
    import html

    pages = dict(duckdb.sql(f"select page_id, html from '{sf_dir}/pages.parquet'").fetchall())
    out = rows(spark, sf_dir, "op4_extract_html")
    assert len(out) == len(pages)
    for r in out:
        body = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        body = re.sub(r"</?\w+$", "", body)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_bpe(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = rows(spark, sf_dir, "op5_bpe")
    assert len(out) == len(docs)
    for r in out:
        ids = t.encode(docs[r["doc_id"]][1] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == brute.sha(t.decode(ids, skip_special_tokens=False))


def test_audio(spark, sf_dir, docs):
    seen = {}
    for r in rows(spark, sf_dir, "op6_telephony_audio"):
        raw = (docs[r["doc_id"]][1] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), brute.sha(payload))
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert seen.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def plain_pcm(payload, codec):
    """Sample by sample from the codes' definitions; then by linear interpolation to twice the rate."""
    pcm = []
    if codec == 7:
        for byte in payload:
            c = 255 - byte
            size = ((c % 16) * 8 + 132) * 2 ** (c // 16 % 8) - 132
            pcm.append(-size if c >= 128 else size)
    elif codec == 6:
        for byte in payload:
            c = byte ^ 0x55
            part, low = c // 16 % 8, c % 16
            size = low * 16 + 8 if part == 0 else (low * 16 + 264) * 2 ** (part - 1)
            pcm.append(size if c >= 128 else -size)
    else:
        for at in range(0, len(payload), 64):
            block = payload[at : at + 64]
            level, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
            pcm.append(level)
            for code in (c for b in block[4:] for c in (b % 16, b // 16)):
                step = int(audio.STEPS[index])
                change = step // 8 + step * (code // 4 % 2) + step // 2 * (code // 2 % 2) + step // 4 * (code % 2)
                level = max(-32768, min(32767, level - change if code >= 8 else level + change))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code % 8]))
                pcm.append(level)
    return [x for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for x in (a, (a + b) // 2)]


def test_audio_features(spark, sf_dir, docs):
    seen = set()
    for r in sorted(rows(spark, sf_dir, "op6_telephony_audio"), key=lambda r: r["doc_id"])[::9]:
        raw = (docs[r["doc_id"]][1] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        codec = (7, 6, 17)[zlib.crc32(payload) % 3]
        pcm = plain_pcm(payload, codec)
        stored = b"".join(x.to_bytes(2, "little", signed=True) for x in pcm)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        assert r["feature"] == f"codec={codec};crc={zlib.crc32(stored)};peak={max(map(abs, pcm))};energy={sum(x * x for x in pcm)};crossings={crossings}"
        form = {7: (8000, 1, 8), 6: (8000, 1, 8), 17: (8000 * 64 // 121, 64, 4)}[codec]
        head = codec.to_bytes(2, "little") + b"\1\0" + (8000).to_bytes(4, "little") + form[0].to_bytes(4, "little") + form[1].to_bytes(2, "little") + form[2].to_bytes(2, "little")
        head += b"\2\0\x79\0" if codec == 17 else b"\0\0"
        wav = b"WAVEfmt " + len(head).to_bytes(4, "little") + head + b"data" + len(payload).to_bytes(4, "little") + payload
        wav = b"RIFF" + len(wav).to_bytes(4, "little") + wav
        assert (r["media_bytes"], r["media_sha256"], r["pcm_bytes"]) == (len(wav), brute.sha(wav), len(stored))
        seen.add(codec)
    assert seen == {6, 7, 17}


def test_quality(spark, sf_dir, docs):
    out = rows(spark, sf_dir, "op7_quality_rules")
    assert len(out) == len(docs)
    for r in out:
        want = brute.statistics(docs[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    good = [r for r in out if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)


def test_chat(spark, sf_dir):
    hard = "</s>[INST] ok [/INST]"
    turns = duckdb.sql(f"select conv_id, turn, role, text from '{sf_dir}/conversations.parquet'").fetchall()
    by = {}
    for c, n, role, text in [*turns, (-1, 0, "user", hard), (-1, 1, "assistant", hard)]:
        by.setdefault(c, []).append((n, role, text or ""))
    out = rows(spark, sf_dir, "op8_chat_format")
    assert len(out) == len(by)
    for r in out:
        own = sorted(by[r["conv_id"]])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == brute.sha("".join(f"{role}\n{t}\n" for _, role, t in own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))


def test_simhash(spark, sf_dir, docs):
    out = {r["doc_id"]: r for r in rows(spark, sf_dir, "op9_simhash")}
    order = sorted(docs)
    fps = [brute.fingerprint(docs[d][1]) for d in order]
    for d, fp, group in zip(order, fps, brute.components(fps), strict=True):
        assert out[d]["fingerprint"] == f"{fp:016x}"
        assert out[d]["component_id"] == min(order[i] for i in group)


def test_packing(spark, sf_dir, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    out = rows(spark, sf_dir, "op10_pack_tokens")
    for r in out:
        ids = np.frombuffer(r["ids"], "<u2")
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == len(ids) == r["n_tokens"] <= 2048 and r["position_resets"] == cu[:-1]
        for k, d in enumerate(r["doc_ids"]):
            got.setdefault(d, []).append((r["doc_starts"][k], ids[cu[k] : cu[k + 1]].tolist()))
    assert len({r["pack_id"] for r in out}) == len(out)
    for d, (_, text, _) in docs.items():
        want = [*t.encode(text or "", add_special_tokens=False).ids, 50256]
        parts = sorted(got[d])
        assert [x for _, p in parts for x in p] == want
