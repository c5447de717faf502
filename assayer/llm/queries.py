"""Registered queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import audit, chat, decontaminate, hardneg, licenses, lm, mixing, near, phrases, quality, secrets, sql, urls, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_mix_sources")
def mix_sources(spark, sf_dir):
    return mixing.mix_table(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_format_chats", sql.CHATS)
def format_chats(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


@query("op3_quality_cascade", sql.QUALITY)
def quality_cascade(spark, sf_dir):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.measure(table(spark, sf_dir, "documents")).select(*columns)


@query("op4_language_model")
def language_model(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query("op5_host_reputation", sql.URLS)
def host_reputation(spark, sf_dir):
    """Pages labelled by the row of ``labels`` with their id: bad if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels)


@query("op6_near_duplicates")
def near_duplicates(spark, sf_dir):
    return near.classes(table(spark, sf_dir, "documents"))


@query("op7_warc_round_trip", sql.ARCHIVE)
def warc_round_trip(spark, sf_dir):
    """Written as whole-file streams, normalised to members, read back by the index."""
    return warc.resolved(warc.normalise(warc.write(table(spark, sf_dir, "pages"))))


@query("op8_secret_scan", sql.SECRETS)
def secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_text(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.span_text(F.col("secret_spans")).alias("spans"),
    )


@query("op9_decontaminate", sql.CONTAMINATION)
def decontamination(spark, sf_dir):
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_phrase_dedup", sql.PHRASES)
def phrase_dedup(spark, sf_dir):
    return phrases.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_hard_negatives", sql.HARD_NEGATIVES)
def hard_negatives(spark, sf_dir):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=shifted)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query("op12_filter_audit", sql.AUDIT)
def filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_license_scan")
def license_scan(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))
