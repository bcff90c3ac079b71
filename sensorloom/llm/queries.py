"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import conversations, decontaminate, embedding_join, hard_negatives, html_text, language, mixing, ngram_join, oracles, passages, quality, repeats, token_files, warc
from sensorloom.llm.registry import query, read
from sensorloom.session import durable


@query("op1_warc", oracles.WARC)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back by the salvage reader."""
    found = warc.archive_round_trip(read(spark, sf_dir, "pages"))
    return found.where("gap_start is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source, weights 1, 2, 3 in turn."""
    docs = read(spark, sf_dir, "documents")
    sized = durable(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    picked, targets, _ = mixing.mix(sized.withColumn("sources", F.array("source")), mixing.cycle_weights)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = [(s, float(t)) for s, t in targets.items()]
    wanted = F.broadcast(spark.createDataFrame(rows, "source string, target double"))  # at most MAX_PATTERNS rows
    totals = durable(sizes.alias("a").join(wanted.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "source_size", "target"))
    joined = picked.alias("p").join(F.broadcast(totals).alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    return joined.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, labels, ["doc_id"])
    return scored.select(
        "doc_id", (quality.fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op4_ngram_join", oracles.NGRAMS)
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"), k=3, percent=90)


@query("op7_embedding_join", oracles.EMBEDDINGS)
def op7_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels and a cosine of 0.98 or more."""
    return embedding_join.embedding_components(read(spark, sf_dir, "embeddings"))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_files.token_files(read(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; it must be on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(read(spark, sf_dir, "pages"))


@query("op9_repeats", oracles.REPEATS)
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 100-byte strings that start earlier."""
    cleaned = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return cleaned.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op6_decontaminate", decontaminate.SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it leaks, with the best window."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op10_passages")
def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share with earlier ones, edited or not."""
    return passages.fuzzy_passages(read(spark, sf_dir, "documents"))


@query("op13_hard_negatives", hard_negatives.SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query("op12_conversations")
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation; those left without rows have nothing to repair."""
    rows = read(spark, sf_dir, "conversations")
    report = conversations.repair_conversations(conversations.damage(rows)).withColumnRenamed("conv_id", "_id")
    every = rows.select("conv_id").distinct()
    joined = every.join(report, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return joined.select("conv_id", *[F.coalesce(n, nothing.get(n, F.lit(0).cast("long"))).alias(n) for n, _ in conversations.REPORT])


@query("op11_language")
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    found = language.identify(read(spark, sf_dir, "documents"))
    return found.select("doc_id", (language.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
