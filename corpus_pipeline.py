"""The corpus pipeline: language, quality, near and exact duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import langid, packing, quality, similar, suffixes
from tidewave.llm._common import free_names, release, table, tables_so_far, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, told with a probability of at least 0.5, whose characters are likelier in it than where
    all pieces are equally likely. Null texts and texts without letters go. All columns and repeated rows stay as they are,
    null ids too (they take no part in the learning). Without labelled rows, or from an empty table, nothing stays."""
    import public_tokenizers

    labelled = docs.where(~langid.held_out()).where("doc_id is not null")
    model = langid.train(labelled, public_tokenizers.path("piece_bpe_32k.model"))
    lang, score, fit = free_names(docs, "lang_pred", "score", "fit")
    found = langid.predict(docs, model, (lang, score, fit))
    return found.where((F.col(lang) != "und") & (F.col(score) >= 0.5) & (F.col(fit) > 0)).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling toward the rows labelled good selects; null and empty texts go.

    Rows are told apart by doc_id (null or not) and text: those that repeat both are kept or go together. All columns stay
    as they are. Without labels all texts with words stay; an empty table gives no rows."""
    kept = quality.select(docs, table(spark, sf_dir, "labels")).where("keep").select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & (quality.text_hash(docs["text"]) == kept["text_hash"])
    return docs.join(kept, same, "left_semi")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates: texts whose sets of 5-word shingles have a Jaccard
    similarity of 0.8 or more are linked, all of them. SimHash fingerprints of the sets and their BK-trees link most; a token-group
    matrix finds what no radius of bits reaches (`similar`). The 3 bits and 3 words of op1 hold for op1 alone.

    Texts without words are one group. One row of each group stays; it has a null doc_id only if its group has no other.
    An empty table gives no rows."""
    return similar.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that occur earlier; n_chars follows the text. Emptied texts stay as rows,
    and null texts become empty. Rows that share a doc_id (or have none) are documents of their own, see
    `suffixes.remove_repeats`. All columns stay; an empty table gives no rows."""
    kind = docs.schema["n_chars"].dataType
    kept, *names = free_names(docs, "kept", "n_bytes", "n_removed", "n_spans")
    out = suffixes.remove_repeats(docs, replace_text=True, names=(kept, *names))
    return out.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences; a null or empty text gives one piece of the end id. Null
    and repeated ids and repeated rows all have pieces; other columns are not read. An empty table gives no rows."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage has written is deleted when the next one's documents are stored."""
    docs = table(spark, sf_dir, "documents")
    mark = tables_so_far()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
