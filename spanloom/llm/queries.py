"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import rotate_perspectives
from .decontam import contamination
from .html_extract import extract_main_text
from .langid import held_out, learn, predict
from .licenses import scan_licences
from .line_dedup import dedup_lines
from .merkle import leaf_hash, merkle_manifest
from .mixing import mix
from .ngram_join import similar_documents
from .quality import judge_quality
from .repair import conversation_hashes, damage, repair_conversations
from .secrets import BASE_RULES, scan_secrets, spans_text
from .subword import held_out as unlearned
from .subword import score_quality, train
from .words import lower_ascii


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its licences and known licence sentences, joined by commas."""
    out = scan_licences(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentences", ",").alias("sentences"), F.size("sentences").cast("long").alias("n_sentences"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_secrets(_read(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]
    number = [_of_kind(k) for k in base]
    plain = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(F.col("id").alias("doc_id"), *number, F.sha2(spans_text(plain), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of lines, number of removed ones, and their numbers from 0."""
    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.concat_ws(",", F.transform("removed_lines", lambda i: i.cast("string"))).alias("removed_lines"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the least doc_id of its class, and the number of documents it is linked with."""
    rows, _ = similar_documents(_read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_shingles")


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation and participant: the rendering, and the trained spans as start:end, joined by commas."""
    out = rotate_perspectives(_read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "part", "participant", "rendered", spans.alias("spans"), "n_turns")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    q = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
    return out.select("doc_id", *[F.col(f"quality.{c}") for c in q])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims are the rows as they are, but for a third of them in whose text A-Z are lower case."""
    docs = _read(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    claim = [*head, F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))]
    return merkle_manifest(docs, [*head, F.col("text")], claim=claim, paths=False).withColumnRenamed("id", "doc_id")


def op12_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, train(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", unlearned(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: faults, cost and audit of its repair, and the hash of the repaired one; zeros if damage left none of its turns."""
    turns = _read(spark, sf_dir, "conversations")
    report, repaired = repair_conversations(damage(turns))
    out = turns.select("conv_id").distinct()
    for part in (report, conversation_hashes(repaired)):
        part = part.withColumnRenamed("conv", "pconv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("pconv")), "left").drop("pconv")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licence_scan": op2_licence_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_language": op4_language,
    "op5_line_dedup": op5_line_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_ngram_join": op7_ngram_join,
    "op8_chat_perspectives": op8_chat_perspectives,
    "op9_html_extract": op9_html_extract,
    "op10_quality": op10_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_subword_quality": op12_subword_quality,
    "op13_conversation_repair": op13_conversation_repair,
}
