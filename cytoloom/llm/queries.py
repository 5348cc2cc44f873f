"""The registered query of each operator, on whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm import conversations, decontam, katz, language, licenses, mixing, ngram_join, sharding, sql, suffix_dedup, topk, toxicity, urls, whitening
from cytoloom.llm.tables import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contamination(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.link_documents(table(spark, sf_dir, "documents"), n=4, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.per_document(mixing.plan_mix(table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urls.train_url_model(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id"), 4, 2))
    model = language.learn(docs.where("not held_out").where("doc_id is not null"))
    rows = language.predict(docs.select("doc_id", "held_out", "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language.held_out(F.col("doc_id"), 5, 1)
    rows, words = katz.score_texts(docs, ~out & F.col("doc_id").isNotNull())
    return rows.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return rows.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.summaries(conversations.repair(damaged))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~out))
    rows = toxicity.score(docs, model)
    return rows.select(
        "doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.sound_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


_ALL = (
    op1_sharding, op2_licenses, op3_decontam, op4_ngram_join, op5_mixing, op6_urls, op7_topk, op8_language, op9_katz,
    op10_suffix_dedup, op11_conversations, op12_toxicity, op13_whitening,
)
QUERIES = {f.__name__: f for f in _ALL}
CHECKS = {name: text for name, text in sql.CHECKS.items() if name in QUERIES}
