"""Near copies by the Jaccard similarity of shingle sets, without loss.

First SimHash fingerprints of the sets are linked through the BK-trees of `simhash`; those links whose sets are similar enough join
texts into groups. A radius of bits that reaches every pair of similarity 0.8 has no sharp end, so pairs that are still apart come
from the token-group matrix of `tokengroups`, which loses none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm._common import discard, free_names, text_or_empty, written
from tidewave.llm.simhash import near_links
from tidewave.llm.tokengroups import Rule, set_rows

#: Five words and a similarity of 0.8 or more.
NEAR = Rule(5, 4, 5)


def fingerprint_pairs(sets: DataFrame, radius: int = 3) -> DataFrame:
    """Candidates (a, b) among sets (s, fp): those of one fingerprint with its least, and the leasts of linked fingerprints."""
    least = written(sets.groupBy("fp").agg(F.min("s").alias("least")), "distinct")
    same = sets.join(least, "fp").select(F.col("least").alias("x"), F.col("s").alias("y"))
    of = lambda fp, s: least.select(F.col("fp").alias(fp), F.col("least").alias(s))
    near = near_links(least, radius).join(of("fp_a", "x"), "fp_a").join(of("fp_b", "y"), "fp_b").select("x", "y")
    pairs = same.union(near).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = written(pairs.distinct(), "fingerprint-pairs")
    discard(least)
    return out


def near_components(docs: DataFrame, rule: Rule = NEAR, crowd: int = 50, rounds: int = 2) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable over links) of every row.

    Texts of equal sets, the empty one of empty and null texts included, are linked. Null doc_ids are never the smallest:
    a component of null doc_ids only has a null component_id. Repeated rows all come back. An empty table gives no rows.
    """
    rows, member = set_rows(docs, rule, fingerprint_pairs, crowd, rounds)
    least = rows.join(member, "s").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "s").join(member.join(least, "label").select("s", "component_id"), "s").select("doc_id", "component_id")


def keep_one(docs: DataFrame, rule: Rule = NEAR) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id. Rows with a null doc_id stay only if their component has no
    other doc_id; of those, and of different texts of the smallest doc_id, one text is chosen by its hash. Of rows that repeat both doc_id
    and text, one stays."""
    rows, member = set_rows(docs, rule, fingerprint_pairs)
    of = rows.join(member, "s").select("label", "k", "doc_id")
    chosen = of.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("x")).select(F.col("x.k").alias("k"))
    repeats = rows.groupBy("k").agg(F.count("*").alias("times"))
    key, times = free_names(docs, "_k", "_times")
    kept = chosen.join(repeats, "k").select(F.col("k").alias(key), F.col("times").alias(times))
    found = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())).join(kept, key)
    once = found.where(F.col(times) > 1).groupBy(key).agg(F.first(F.struct(*docs.columns)).alias(times)).select(f"{times}.*")
    return found.where(F.col(times) == 1).select(*docs.columns).union(once)
