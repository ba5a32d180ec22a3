"""Quality selection by importance resampling.

Texts are bags of hashed n-grams: each word, pair of adjacent words and pair of adjacent word shapes falls into one of
2^bits buckets. Two
generative models are bucket distributions: of target text (a bounded sample of rows labelled good) and of raw text (all
documents). The log ratio of a text sums log(target / raw) over its n-grams. Gumbel noise, a function of the id, is added,
and the k largest sums are kept: a sample without replacement in proportion to the ratios. k is the expected number of
target texts: the sum over all documents of min(1, share of target labels * ratio).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import lean, table, text_or_empty, written
from tidewave.llm.chunks import cut_tails, text_slices


def word_shape(word: str) -> str:
    """Runs of capitals as A, of other letters as a, of digits as 0, other characters as they are, runs of them once."""
    shape = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", word)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "0", shape), flags=re.S)


def shape_codes(words):
    """CRC-32 of the shape of every word of an Arrow array. Words of letters in one case or with one capital, punctuation after
    them or not, have few shapes; others are taken one by one."""
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    stem, tail = cut_tails(words)
    alpha = np.asarray(pc.utf8_is_alpha(stem))
    long = np.asarray(pc.utf8_length(stem)) > 1
    kind = np.select([alpha & np.asarray(pc.utf8_is_lower(stem)), alpha & long & np.asarray(pc.utf8_is_title(stem)) & ~np.asarray(pc.match_substring_regex(stem, r"^\p{Lt}")), alpha & long & np.asarray(pc.utf8_is_upper(stem))], [0, 1, 2], -1)
    tails = tail.dictionary_encode()
    code = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass"))
    few = np.array([[code(word_shape(w + t)) for w in ("aa", "Aa", "AA")] for t in tails.dictionary.to_pylist()], np.uint64).reshape(-1, 3)
    out = few[np.asarray(tails.indices), np.maximum(kind, 0)] if len(few) else np.zeros(len(words), np.uint64)
    rest = np.flatnonzero(kind < 0)
    out[rest] = [code(word_shape(w)) for w in words.take(pa.array(rest)).to_pylist()]
    return out


def ngram_buckets(texts, bits: int = 13):
    """The n-grams of an Arrow array of texts: number of the text and bucket, for every word, every pair of adjacent words and
    every pair of adjacent word shapes. Words are what stands between white space.

    Pairs of equal words share bucket 0, so that runs of one word tell whatever the word is. Distinct words are hashed once a call.
    """
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(texts)
    words = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    some = np.asarray(pc.binary_length(words)) > 0
    owner, coded = owner[some], words.filter(pa.array(some)).dictionary_encode()
    code = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass"))
    distinct, index = coded.dictionary, np.asarray(coded.indices)
    one = np.fromiter(map(code, distinct.to_pylist()), np.uint64, len(distinct))[index]
    shape = shape_codes(distinct)[index]
    top = np.uint64(64 - bits)
    follows = owner[1:] == owner[:-1]

    def pairs(x):
        m = x * np.uint64(0x9E3779B97F4A7C15)
        return ((m[:-1] ^ (m[1:] * np.uint64(0xD6E8FEB86659FD93)) ^ (m[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> top)[follows]

    two = np.where((one[:-1] == one[1:])[follows], np.uint64(0), pairs(one))
    buckets = np.concatenate([one * np.uint64(0x9E3779B97F4A7C15) >> top, two, pairs(shape + np.uint64(1 << 33))]).astype(np.int64)
    return np.concatenate([owner, owner[1:][follows], owner[1:][follows]]), buckets


def fit(docs: DataFrame, labels: DataFrame, bits: int = 13, sample_rows: int = 20_000, prior: float = 1000.0) -> dict:
    """Log ratios per bucket and the share of target labels.

    Target: rows of `labels` with quality 1 and toxic not 1; about `sample_rows` labels take part, by a hash of doc_id, and
    are broadcast (16 bytes each). Raw: all rows of `docs`. Both are counted in one pass; the driver sees two sums per bucket.
    Without any target label all log ratios are 0 and the share is 1.
    """
    import numpy as np

    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("bad"))
    n = max(1, known.count())
    share = min(1 << 20, -(-sample_rows * (1 << 20) // n))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("label sample")), F.lit(1 << 20)) < share).select(F.col("doc_id").alias("_label_id"), ((F.col("good") == 1) & (F.col("bad") == 0)).alias("_target"), "good")
    sample = written(sample, "labels")
    good = sample.agg(F.avg(F.col("_target").cast("int"))).first()[0]
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample.where("_target").select("_label_id", "_target")), F.col("doc_id") == F.col("_label_id"), "left").select("text", F.coalesce("_target", F.lit(False)).alias("target"))

    @lean
    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm.quality import ngram_buckets

        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column("text"), 4 << 20):
                text, buckets = ngram_buckets(batch.column("text").slice(a, b - a), bits)
                raw += np.bincount(buckets, minlength=1 << bits)
                target += np.bincount(buckets[np.asarray(batch.column("target").slice(a, b - a))[text]], minlength=1 << bits)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used), "raw": pa.array(raw[used]), "target": pa.array(target[used])})

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(1 << bits), np.zeros(1 << bits)
    for r in sums:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    # The target model starts from the raw one with the weight of `prior` n-grams, so that few labels say little either way.
    raw /= raw.sum()
    ratio = np.log((target + prior * raw) / (target.sum() + prior) / raw)
    if good is None or not target.any():
        return {"ratio": np.zeros(1 << bits), "share": 1.0, "bits": bits}
    return {"ratio": ratio, "share": float(good), "bits": bits}


def text_hash(text: Column) -> Column:
    """What tells texts of one doc_id apart; null and empty texts are alike."""
    return F.xxhash64(text_or_empty(text))


def score(docs: DataFrame, model: dict, seed: int = 7) -> DataFrame:
    """doc_id, text_hash, log_ratio, ngrams and sample_key (log ratio plus Gumbel noise, a function of doc_id) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), text_hash(F.col("text")).alias("text_hash"), (-F.log(-F.log(uniform))).alias("noise"))

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm.quality import ngram_buckets

        m = shared.value
        for batch in batches:
            log, ngrams = [np.zeros(0)], [np.zeros(0, np.int64)]
            for a, b in text_slices(batch.column("text"), 4 << 20):
                text, buckets = ngram_buckets(batch.column("text").slice(a, b - a), m["bits"])
                log.append(np.bincount(text, m["ratio"][buckets], b - a))
                ngrams.append(np.bincount(text, minlength=b - a))
            log, ngrams = np.concatenate(log), np.concatenate(ngrams)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(log), pa.array(ngrams, pa.int64()), pa.array(log + np.asarray(batch.column("noise")), pa.float64())], ["doc_id", "text_hash", "log_ratio", "ngrams", "sample_key"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, log_ratio double, ngrams long, sample_key double")


def kth_largest(rows: DataFrame, column: str, k: int, enough: int = 5000) -> float:
    """The exact k-th largest value of a column without nulls (1 <= k <= count), by narrowing an interval with quantiles."""
    low, high, rank = float("-inf"), float("inf"), k
    while True:
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        n = inside.count()
        if n <= enough:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[rank - 1]
        cuts = sorted({*inside.select(F.percentile_approx(column, [i / 500 for i in range(1, 500)], 20_000)).first()[0]})
        if len(cuts) == 1 and low == high:
            return cuts[0]
        at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column)))  # 0: below the first cut
        counts = {r["b"]: (r["n"], r["least"], r["most"]) for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect()}
        for b in sorted(counts, reverse=True):
            if rank <= counts[b][0]:
                low, high = counts[b][1:]
                break
            rank -= counts[b][0]
        if low == high:
            return low


def select(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, text_hash, log_ratio, sample_key and keep of every row of `docs` (doc_id, text).

    keep: sample_key is at least the k-th largest; rows tied with it all stay. Null texts count as empty, and texts without
    words have no n-grams: they are not kept and do not count. Repeated rows have equal keys. Without labels all rows with
    words are kept. An empty table gives no rows.
    """
    model = fit(docs, labels, sample_rows=sample_rows)
    scored = written(score(docs, model), "quality")
    use = scored.where("ngrams > 0")
    expected = use.agg(F.sum(F.least(F.lit(1.0), F.lit(model["share"]) * F.exp(F.least("log_ratio", F.lit(50.0))))), F.count("*")).first()
    k = min(expected[1], round(expected[0] or 0)) if model["ratio"].any() else expected[1]
    bar = kth_largest(use, "sample_key", k) if k else float("inf")
    return scored.select("doc_id", "text_hash", "log_ratio", "sample_key", ((F.col("ngrams") > 0) & (F.col("sample_key") >= F.lit(bar))).alias("keep"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance ratio, sampling key and decision for every document."""
    return select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
