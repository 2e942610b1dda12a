"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import oracle
from emberline.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning: by crc32 of its doc_id's text; documents without a doc_id are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and how much of it; null or empty texts and items match nothing, repeated documents give a row each key."""
    from emberline.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text; null texts and null doc_ids are left alone."""
    from emberline.llm.lines import drop_recurring_lines

    left = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_dropped", F.col("text").alias("text_left"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that the forest takes for secrets, with their place; null and empty texts give none."""
    from emberline.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; null text counts as empty, a null doc_id as held out, and labels without a score or doc_id teach nothing."""
    from emberline.llm.quality import fit_quality, quality_score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs.filter(~held_out(5, 0)), table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    scored = docs.select("doc_id", held_out(5, 0).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; ``und`` for null texts and those without a letter, a null doc_id counts as held out and a null lang teaches nothing."""
    from emberline.llm.langid import fit_language_centroids, predicted_language

    docs = table(spark, sf_dir, "documents")
    model = fit_language_centroids(docs.filter(~held_out(3, 1)))
    found = docs.select("doc_id", held_out(3, 1).alias("held_out"), predicted_language(model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.*")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; null counts as empty."""
    from emberline.llm.tokens import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path("piece_bpe_32k.model")).drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have fingerprint zero, rows with equal doc_ids are one document, a null doc_id joins but never names a component."""
    from emberline.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their place in a sequence; null counts as empty, repeated doc_ids are documents of their own."""
    from emberline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; null, zero and non-finite vectors and null labels link with nothing, repeated vec_ids are vectors of their own."""
    from emberline.llm.embed import vector_links

    return vector_links(table(spark, sf_dir, "embeddings"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; null counts as empty (one end token), a null doc_id as held out."""
    from emberline.llm.lm import fit_bigrams, lm_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_bigrams(docs.filter(~held_out(7, 2)))
    return lm_scores(model, docs).withColumn("held_out", held_out(7, 2)).drop("text")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; null and empty texts and items match nothing, repeated doc_ids are documents of their own."""
    from emberline.llm.ranked import ranked_search

    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; a null text has none, a null source is the last source, repeated doc_ids are documents of their own."""
    from emberline.llm.mixing import mix_sources, words_taken

    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", words_taken(F.col("spans")).alias("taken"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two tokenizers; null and empty texts and those that a tokenizer doesn't give back have zeros, repeated doc_ids are documents of their own."""
    from emberline.llm.align import alignment_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment_counts(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_embeddings": op9_embeddings,
    "op10_lm": op10_lm,
    "op11_search": op11_search,
    "op12_mixing": op12_mixing,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}
#: SQL has no way to say the others (hash votes, tokenizers, trained models, alignments), so each is tested against brute force instead.
ORACLE_SQL: dict[str, str] = {"op11_search": oracle.SEARCH, "op12_mixing": oracle.MIXING}
