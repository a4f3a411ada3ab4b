"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, binpack, bpe, chat, extraction, lexical, mixing, packing, phrases, ppm, quality, secrets, simhash
from .common import stored, table
from .sql import ORACLE

VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stored(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size")))
    mixed = mixing.mix(sized, F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < 3)
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages, extraction.fit(pages))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    tokens = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", "raw", F.length("raw").alias("n"))
    padded = docs.select(
        "doc_id", F.col("n").cast("long").alias("n_bytes"),
        F.concat("raw", F.expr("cast(repeat('\\0', if(n = 0, 64, pmod(-n, 64))) as binary)")).alias("payload")
    )
    # the codec follows from the payload, so equal texts are stored alike
    kinds = F.element_at(F.array(F.lit(audio.MULAW), F.lit(audio.ALAW), F.lit(audio.ADPCM)), (F.crc32("payload") % 3 + 1).cast("int"))
    media = stored(audio.store(padded.select("doc_id", "n_bytes", "payload", kinds.alias("kind")), kind="kind").drop("payload", "kind"))
    heard = audio.decode(media)
    feature = F.format_string("codec=%d;crc=%d;peak=%d;energy=%d;crossings=%d", "codec", F.crc32("pcm"), "peak", "energy", "crossings")
    return heard.select(
        "doc_id", "n_bytes", F.length("data").cast("long").alias("payload_bytes"), F.sha2("data", 256).alias("payload_sha256"), F.crc32(F.expr("substring(data, length(data) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
        F.length("pcm").cast("long").alias("pcm_bytes"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.STATISTICS, "base_failed", "kept", "rule")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    chats = chat.conversations(turns.unionByName(more))
    read = chats.select("conv_id", "valid", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"))
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescaped(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), lost.alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid"
    )
    return out.select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars", "valid"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    )


def op12_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = binpack.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(WORD_VOCABULARY))
    packed = binpack.pack(stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_lm_score, op3_secret_scan, op4_extract_html, op5_bpe, op6_telephony_audio, op7_quality_rules, op8_chat_format, op9_simhash, op10_pack_tokens, op11_lexical_search, op12_bin_packing, op13_collocations)
}
__all__ = ["ORACLE", "QUERIES"]
