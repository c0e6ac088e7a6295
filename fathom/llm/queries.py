"""The queries of this folder, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import chat, decontaminate, jaccard, language, media, mixture, pages, secrets, suffixes, tokens
from fathom.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, h = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.col(h)["items"])
    return found.select("doc_id", F.col(h)["n_words"].alias("n_words"), decontaminate.n_hit(h).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontaminate.is_contaminated(h).alias("contaminated"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mixture.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate(table(spark, sf_dir, "conversations")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, base, every = secrets.scan(docs)
    b = F.col(base)
    return out.select("doc_id", secrets.counted(b, 0).alias("n_assign"), secrets.counted(b, 1).alias("n_access"), secrets.counted(b, 2).alias("n_hex"), F.sha2(secrets.listing(b), 256).alias("base_sha256"), secrets.listing(F.col(every)).alias("spans"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out, lang, score = language.identify(docs)
    return out.select("doc_id", language.held_out().alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


QUERIES |= {"op1_suffix_dedup": op1_suffix_dedup, "op2_media_sniff": op2_media_sniff, "op3_decontaminate": op3_decontaminate, "op4_mix_sources": op4_mix_sources, "op5_language": op5_language, "op6_page_text": op6_page_text, "op8_chat_rotation": op8_chat_rotation, "op7_jaccard_join": op7_jaccard_join, "op9_token_files": op9_token_files, "op10_secret_scan": op10_secret_scan}
