"""Weighted SimHash fingerprints with DataFrame functions only, and their search through permuted block tables.

Terms are runs of five words of the text in lower case (fewer words: all of them), each weighted by how often it occurs.
The vote on a bit is the weight of the terms whose hash has the bit less the weight of those whose hash has not, so a bit
is set if more than half of the weight has it. Two bits share a long in the sums: (hash >>> i) & 0x100000001 counts bits
i and i + 32.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm._common import table, text_or_empty, written
from tidewave.llm.simhash import block_masks

PAIR = 0x100000001


def fingerprint_rows(rows: DataFrame, keys: list[str], text_col: str, width: int = 5) -> DataFrame:
    """`keys` and fp (long) of every row; `keys` must tell rows apart. Texts without words have fingerprint 0."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[ \t\n\r\x0B\f]+"), lambda w: w != "")
    hashed = rows.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_h")).withColumn("_size", F.size("_h"))
    each = hashed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_size") - width, F.lit(0)))))
    term = F.when(F.col("_size") < width, F.xxhash64("_h")).otherwise(F.xxhash64(*[F.get("_h", F.col("_i") + k) for k in range(width)]))
    voted = each.select(*keys, F.when(F.col("_size") > 0, term).alias("t"))
    sums = [F.sum(F.shiftrightunsigned("t", i).bitwiseAND(F.lit(PAIR))).alias(f"b{i}") for i in range(32)]
    votes = voted.groupBy(*keys).agg(*sums, F.count("t").alias("w"))
    bit = lambda count, i: F.when(2 * count > F.col("w"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))
    parts = [bit(F.col(f"b{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i) for i in range(32)] + [bit(F.shiftrightunsigned(f"b{i}", 32), i + 32) for i in range(32)]
    return votes.select(*keys, F.when(F.col("w") > 0, reduce(Column.bitwiseOR, parts)).otherwise(F.lit(0)).cast("long").alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the two weighted term sets, from 0 to 1: cos(pi * differing bits / 64), at least 0."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(3.141592653589793 / 64)))


def near_fingerprints(queries: DataFrame, known: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All pairs (fp, near_fp) of a fingerprint of `queries` and a different one of `known` within `radius` bits.

    Both have a column fp; repeats count once. Each table permutes one choice of `blocks` - `radius` blocks to the front and
    is an equi-join on it; a pair is given by the first table in which it agrees, so once.
    """
    masks = block_masks(blocks, radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("front")) for t, m in enumerate(masks)]))
    spread = lambda df: df.select("fp").distinct().select("fp", tables.alias("s")).select("fp", "s.t", "s.front")
    a, b = spread(queries).alias("a"), spread(known).alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = reduce(lambda rest, tm: F.when(differ.bitwiseAND(F.lit(tm[1])) == 0, F.lit(tm[0])).otherwise(rest), reversed(list(enumerate(masks))), F.lit(len(masks)))
    near = (F.col("a.t") == F.col("b.t")) & (F.col("a.front") == F.col("b.front")) & (F.bit_count(differ) <= radius) & (F.col("a.fp") != F.col("b.fp")) & (first == F.col("a.t"))
    return a.join(b, near).select(F.col("a.fp").alias("fp"), F.col("b.fp").alias("near_fp"))


def _bucket(at: Column, cuts: list[tuple[bool, int | None, int]]) -> Column:
    """How many of the ascending keys `cuts` are not after the key `at`; found among about sqrt(n) of them, twice."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    kind = "struct<known: boolean, doc_id: bigint, h: bigint>"
    rows = lambda keys: [{"known": k, "doc_id": i, "h": h} for k, i, h in keys]
    literal = lambda value, of: F.from_json(F.lit(json.dumps(value)), f"array<{of}>")
    passed = lambda keys: F.size(F.filter(keys, lambda c: c <= at))
    group = passed(literal(rows(g[0] for g in groups), kind))
    within = passed(F.get(literal([rows(g) for g in groups], f"array<{kind}>"), group - 1))
    return F.when(group == 0, 0).otherwise((group - 1) * width + within)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows of `docs` (doc_id, text) in ascending doc_id order with the text that follows: bucket, n (place in the bucket),
    own (false for copies of the next bucket's first row that close a bucket), doc_id, text, next_text.

    The order is cut into buckets (four to a shuffle partition) at keys of a sample (sixteen to a bucket); these and one key per
    bucket are all that the driver sees. Null ids come first; ties go by the text's hash, then the text, so rows that share
    an id fall into many buckets; only rows that repeat both id and text meet in one. The last row is followed by the first.
    Null texts are empty.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h"))
    ascending = lambda keys: sorted({tuple(k) for k in keys}, key=lambda k: (k[0], k[1] or 0, k[2]))
    sample = rows.sample(min(1.0, 16 * buckets / max(1, docs.count())), seed=9).select(place.alias("at"))
    few = ascending(r["at"] for r in sample.collect())
    keyed = rows.withColumn("at", place).withColumn("bucket", _bucket(F.col("at"), ascending(few[len(few) * i // buckets] for i in range(1, buckets)) if few else []))
    heads = sorted((r["bucket"], *r["first"]) for r in keyed.groupBy("bucket").agg(F.min("at").alias("first")).collect())
    before = [(*head[1:], heads[i - 1][0]) for i, head in enumerate(heads)]
    known = spark.createDataFrame(before, "known boolean, id long, h long, previous int")
    ends = keyed.join(F.broadcast(known), F.col("at.doc_id").eqNullSafe(F.col("id")) & (F.col("at.h") == known["h"]))
    ends = ends.select("doc_id", "text", F.col("previous").alias("bucket"), F.lit(False).alias("own"), "at")
    keyed = keyed.select("doc_id", "text", "bucket", F.lit(True).alias("own"), "at").union(ends)
    order = Window.partitionBy("bucket").orderBy(F.desc("own"), "at", "text")
    return keyed.select("bucket", F.row_number().over(order).alias("n"), "own", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike it is to that and to the next document.

    Returns doc_id, n_chars, edited_sha256, fp (long), fingerprint, edited_fingerprint (hex), near_edited and near_next. Every
    row comes back, repeated ones too; a single document is followed by itself; an empty table gives no rows.
    """
    rows = with_next(docs)
    take = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - take), F.substring(F.col("next_text"), F.lit(1), take))
    known = rows.withColumn("edited", F.when(F.col("own"), edited))
    facts = ["own", "doc_id", "n_chars", "edited_sha256"]
    known = known.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    # The facts travel as grouping keys, so that the texts are shuffled once.
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.coalesce("edited", F.lit("")).alias("body"))))
    keys = ["bucket", "n", "kind", *facts]
    votes = fingerprint_rows(known.select("bucket", "n", *facts, kinds.alias("k")).select("bucket", "n", *facts, "k.kind", "k.body"), keys, "body")
    of_kind = lambda k: F.max(F.when(F.col("kind") == k, F.col("fp")))
    both = votes.groupBy("bucket", "n").agg(*[F.max(c).alias(c) for c in facts], of_kind(0).alias("fp"), of_kind(1).alias("edited_fp"))
    order = Window.partitionBy("bucket").orderBy("n")
    joined = both.withColumn("next_fp", F.lead("fp").over(order)).where("own")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", "fp", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; near_count, for documents whose doc_id is divisible by 100, is how
    many other documents have a fingerprint within 3 bits."""
    known = written(edited_likeness(table(spark, sf_dir, "documents")), "fingerprints")
    asked = known.where("doc_id % 100 = 0").select("fp").distinct()
    sizes = known.groupBy("fp").agg(F.count("*").alias("rows"))
    near = near_fingerprints(asked, sizes).union(asked.select("fp", F.col("fp").alias("near_fp")))
    counts = near.join(sizes.withColumnRenamed("fp", "near_fp"), "near_fp").groupBy("fp").agg((F.sum("rows") - 1).alias("found"))
    return known.join(counts, "fp", "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.when(F.col("doc_id") % 100 == 0, F.col("found")).alias("near_count"))


QUERIES = {"op9_fingerprints": op9_fingerprints}
SQL: dict[str, str] = {}
