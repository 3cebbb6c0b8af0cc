"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpisleuth.llm import (
    decontaminate, forest, langid, licenses, minhash, packing, pii, piecewise, quality, revisits, tournament, toxicity, variants,
)
from kpisleuth.llm.common import held_out, table
from kpisleuth.session import tuned


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = Query(lambda spark, folder: fn(tuned(spark), folder), sql)
        return fn

    return register


@query("op1_best_fit_packing")
def best_fit_packing(spark, folder):
    return packing.packed_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_minhash_near_dedup")
def minhash_near_dedup(spark, folder):
    return minhash.near_copies(table(spark, folder, "documents"))


PSEUDONYM_KEY = "kpisleuth-demonstration-key"  # a deployment passes its own secret


@query("op8_pii_pseudonyms")
def pii_pseudonyms(spark, folder):
    return pii.pseudonymise(table(spark, folder, "documents"), PSEUDONYM_KEY).select(
        "doc_id", "text", *[F.col(f"pii_found.{kind}").alias(f"n_{kind}") for kind in pii.KINDS])


@query("op9_license_scan", licenses.scan_sql())
def license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"), licenses.known_digests(spark))


@query("op10_warc_revisits", revisits.resolved_pages_sql())
def warc_revisits(spark, folder):
    found = revisits.resolve(revisits.captures_of_pages(table(spark, folder, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.withColumn("headers", F.array_join(pairs, "; "))


@query("op3_language_id")
def language_id(spark, folder):
    docs, held = table(spark, folder, "documents"), held_out("doc_id", 4, 2)
    model = langid.fit(docs, ~held)
    return langid.classify(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")


@query("op4_toxicity_crf")
def toxicity_crf(spark, folder):
    docs, held = table(spark, folder, "documents"), held_out("doc_id", 5, 0)
    field = toxicity.fit(docs, table(spark, folder, "labels"), ~held)
    return toxicity.score(docs, field, held).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@query("op5_quality_nbsvm")
def quality_nbsvm(spark, folder):
    docs, held = table(spark, folder, "documents"), held_out("doc_id", 5, 0)
    model = quality.fit(docs, table(spark, folder, "labels"), ~held)
    return quality.score(docs, model, held).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_hash_prefix_forest")
def hash_prefix_forest(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op6_benchmark_decontamination")
def benchmark_decontamination(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_piece_codes")
def piece_codes(spark, folder):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piecewise.decoded(piecewise.encoded(table(spark, folder, "documents"), model), model).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op12_spelling_variants", variants.variants_sql())
def spelling_variants(spark, folder):
    return variants.variants(table(spark, folder, "documents"))


@query("op13_centroid_tournament", tournament.clusters_sql())
def centroid_tournament(spark, folder):
    return tournament.clustered(table(spark, folder, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", tournament.centroid_digest(F.col("centroid")).alias("centroid_sha256"))
