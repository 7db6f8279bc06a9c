"""The registered queries: each applies one operator, with its defaults, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.llm import (
    decontamination,
    filter_audit,
    jaccard,
    language_id,
    language_model,
    licenses,
    manifest,
    mixing,
    pieces,
    quality_model,
    rules,
    toxicity,
    urls,
)
from ordersight.llm.registry import QUERIES, TWINS, query, table

__all__ = ["QUERIES", "TWINS"]


@query("op3_quality_rules", rules.twin_sql())
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judge(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_stop_words",
        "n_lines",
        "failed",
    )


@query("op9_mix_sources")
def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op4_url_filter", urls.twin_sql())
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urls.judge(pages, urls.rules_table(spark), urls.listed_pages(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op2_decontamination", decontamination.twin_sql())
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scanned = decontamination.scan(docs, table(spark, folder, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op8_ngram_jaccard")
def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def remainder(id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the split into training and held-out rows."""
    return F.crc32(F.col(f"`{id}`").cast("string")) % divisor


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = toxicity.train(docs.filter(~held_out), table(spark, folder, "labels").select("doc_id", "toxic"))
    scored = docs.withColumn("score", toxicity.score(model, F.col("text")))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    vectors = quality_model.with_statistics(table(spark, folder, "documents").select("doc_id", "text"))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = quality_model.train(vectors.filter(~held_out), table(spark, folder, "labels").select("doc_id", "quality"))
    scored = vectors.withColumn("score", quality_model.score(model, F.col("_vector")))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    found = docs.withColumn("_found", language_id.language(model, F.col("text")))
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score")
    )


@query("op10_language_model")
def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    scored = language_model.score(docs.withColumn("_learn", ~held_out), "_learn")
    return scored.select(
        "doc_id", (~F.col("_learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", licenses.find(F.col("text")).alias("_found"))
    names = F.array_sort(F.array_distinct(F.col("_found.license")))
    return found.select(
        "doc_id",
        F.size("_found").cast("long").alias("n_found"),
        F.concat_ws(",", names).alias("licenses"),
        F.coalesce(F.array_max(F.col("_found.coverage")), F.lit(0.0)).alias("coverage"),
        F.col("_found").alias("found"),
    )


PIECES = "piece_bpe_32k.model"


@query("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(PIECES)
    encoded = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), path)
    decoded = encoded.withColumn("decoded", pieces.decoder(path)("ids"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        pieces.digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_filter_audit", filter_audit.twin_sql())
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, folder, "labels").select("doc_id", "quality", "toxic"))


TAMPERED = 3  # every third document, by the crc32 of its id


@query("op11_merkle_manifest", manifest.twin_sql())
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    docs = table(spark, folder, "documents").select(*columns)
    leaf = manifest.leaf(*[F.col(c) for c in columns])
    changed = F.when(remainder("doc_id", TAMPERED) == 0, manifest.leaf(*map(F.col, columns[:-1]), manifest.lowered("text")))
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), changed.alias("tampered"))
    proved = manifest.build(leaves, leaf="leaf", group="lang", order="doc_id", keep=("doc_id", "tampered"))
    folded = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
