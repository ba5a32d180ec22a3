"""Spelling variants: words one edit apart, found through pivotal grams.

All bigrams of the vocabulary are in one order, rare ones first. A word's prefix is its three first bigrams in that order (with all that are
equal to the third); two of them that do not overlap are its pivots, chosen by dynamic programming so that they are as rare as can be. One
edit breaks at most one of two disjoint bigrams, so for two words within one edit, a pivot of the one whose prefix ends first is in the
prefix of the other, at most one place away: the right pivot with all that follows if the edit begins left of it, else the left pivot with all before it.
A word is in four parts, and the edit is in one of them: pivots are joined with prefixes by bigram, place, length, and all letters outside of that part that
stay, three quarters of the word or so. The pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import discard, lean, table, text_or_empty, written
from tidewave.llm.chunks import text_slices

#: Runs of letters that are taken as words.
RUN = "[A-Za-zÀ-ÿ]+"
#: Parts of a word, of which an edit is in one.
PARTS = 4
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def corpus_words(docs: DataFrame, noise: int = 97, shortest: int = 5, fewest: int = 3, held: int = 32 << 20) -> DataFrame:
    """word, n of the words of at least `shortest` letters that occur `fewest` times or more.

    A-Z become a-z. Where the unsigned crc32 of "<doc_id>:<run>" is a multiple of `noise`, the run loses the letter at the crc32 modulo
    its length. A null doc_id counts as empty text. A task holds counts of words of about `held` bytes and then passes them on.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_or_empty().alias("text"))

    @lean
    def run(batches: Iterator) -> Iterator:
        import re
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa

        find, counts, letters = re.compile(RUN).findall, Counter(), 0
        rows_of = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for a, b in text_slices(batch.column("text"), 2 << 20):
                for doc_id, text in zip(batch.column("id").slice(a, b - a).to_pylist(), batch.column("text").slice(a, b - a), strict=True):
                    own = Counter(find(text.as_py().translate(_LOWER)))
                    before = crc32(f"{doc_id}:".encode())
                    for word, n in own.items():
                        h = crc32(word.encode(), before)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= shortest:
                            if word not in counts:
                                letters += len(word) + 100
                            counts[word] += n
                    if letters > held:
                        yield rows_of()
                        counts.clear()
                        letters = 0
        if counts:
            yield rows_of()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def pivots_of(places: list[int], weights: list[int]) -> tuple[int, int]:
    """Which two of some bigrams (places ascending) do not overlap and have the least summed weight.

    best[i] is the lightest bigram up to the i-th; the second pivot is any that starts two places or more after it."""
    best, found, last = [], None, -1
    for i, place in enumerate(places):
        while last + 1 < i and places[last + 1] + 2 <= place:
            last += 1
        if last >= 0:
            cost = weights[i] + weights[best[last]]
            if found is None or cost < found[0]:
                found = (cost, best[last], i)
        best.append(i if not best or weights[i] < weights[best[-1]] else best[-1])
    return found[1], found[2]


def parts_of(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the parts of a word of n letters."""
    ends = [n * k // PARTS for k in range(PARTS + 1)]
    return [(a, b) for a, b in zip(ends, ends[1:]) if a < b]  # noqa: B905


def prefix_keys(word: str, places: list[int]) -> Iterator[str]:
    """What a word is found by: for each bigram of its prefix and each part that the edit may be in, the letters that stay. With all up to the bigram's end
    those before the part and after it; with all from its start on likewise."""
    n = len(word)
    parts = parts_of(n)
    for i in places:
        for a, b in parts:
            if i + 2 < b and i + 3 <= n:  # the other's right pivot comes later, and one edit takes one letter of it at most
                yield f"<{n} {i} {word[: max(a, i + 2)]} {word[b:]}"
            if 0 < i >= a:  # the other's left pivot comes before
                yield f">{n} {i} {word[:a]} {word[min(b, i) :]}"


def pivot_keys(word: str, left: int, right: int) -> Iterator[str]:
    """What a word with pivots at two places looks for: those of `prefix_keys` of words one edit away whose prefix has the pivot that the edit leaves, that is
    the left one where it begins at the right one or later."""
    for n in (len(word) - 1, len(word), len(word) + 1):
        off = len(word) - n
        for a, b in parts_of(n):
            if right < b:
                yield f"<{n} {left} {word[: max(a, left + 2)]} {word[b + off :]}"
            if a <= right - off:
                yield f">{n} {right - off} {word[:a]} {word[min(b, right - off) + off :]}"


def gram_rows(words: DataFrame, counts: dict[str, int], pivots: bool) -> DataFrame:
    """word, third (where its prefix ends in the order of bigrams), key: a hash of each of its `pivot_keys` or `prefix_keys`. `counts` of bigrams is
    bounded by the letters there are."""
    shared = words.sparkSession.sparkContext.broadcast((counts, {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}))

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        from tidewave.llm.spelling import pivot_keys, pivots_of, prefix_keys

        count, rank = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part, thirds, times, keys = whole.column("word").slice(at, 4096), [], [], []
                for word in part.to_pylist():
                    grams = [word[i : i + 2] for i in range(len(word) - 1)]
                    ranks = [rank[g] for g in grams]
                    third = sorted(ranks)[2]
                    places = [i for i, r in enumerate(ranks) if r <= third]
                    if pivots:
                        left, right = pivots_of(places, [count[grams[i]] for i in places])
                        own = pivot_keys(word, places[left], places[right])
                    else:
                        own = prefix_keys(word, places)
                    before = len(keys)
                    keys += [xxh64_intdigest(key.encode()) for key in own]
                    thirds.append(third)
                    times.append(len(keys) - before)
                row = np.repeat(np.arange(len(times)), times)
                columns = [part.take(pa.array(row)), pa.array(np.array(thirds, np.int32)[row]), pa.array(np.array(keys, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "third", "key"])

    return words.select("word").mapInArrow(run, "word string, third int, key long")


def sorted_join(rows: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side. Spark sizes a table by its compressed files, and one row of them may become dozens of keys within mapInArrow,
    which it doesn't count: tables far beyond the driver's memory would be broadcast as small ones."""
    return rows.join(other.hint("merge"), on, how)


def met_words(words: DataFrame) -> DataFrame:
    """word, other: pairs of words that a pivot brings together, all those one edit apart among them (in one order at least)."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("g"))
    counts = {r.g: r.n for r in grams.groupBy("g").agg(F.count("*").alias("n")).collect()}  # at most the square of the letters
    found = gram_rows(words, counts, False).select(F.col("word").alias("other"), F.col("third").alias("later"), "key")
    met = sorted_join(gram_rows(words, counts, True), found, "key").where((F.col("third") <= F.col("later")) & (F.col("word") != F.col("other")))
    return met.select("word", "other")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, near) of words of `words` (distinct, at least four letters) one insertion, deletion or replacement apart; both orders."""
    met = met_words(words).where(F.levenshtein("word", "other", 1) == 1)
    pairs = written(met.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct(), "near")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))


def variants(docs: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `corpus_words`.

    form: the near word of largest n (ties: smallest in code-point order) if that is `ratio` times the word's n or more, else null; root: the last word
    when forms are followed, the word itself without one. Null and empty texts have no words; repeated rows count each; other columns are not
    read. An empty table gives no rows.
    """
    words = written(corpus_words(docs), "words")
    near = sorted_join(near_words(words), words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("x"))
    known = sorted_join(words, best, "word", "left").withColumn("top", -F.col("x.down"))
    enough = F.col("top") >= ratio * F.col("n")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("x.near")).alias("form"), F.when(enough, F.col("top")).alias("form_n")), "forms")
    steps = written(known.where("form is not null").select("word", F.col("form").alias("to")), "steps")
    while True:  # every round doubles the steps taken; n doubles with every step, so there are few
        on = steps.select(F.col("word").alias("to"), F.col("to").alias("on"))
        after = written(sorted_join(steps, on, "to", "left").select("word", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), "steps")
        done = after.where("moved").isEmpty()
        discard(steps)
        steps = after
        if done:
            break
    out = sorted_join(known, steps.select("word", F.col("to").alias("root")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and counts of every word of the documents."""
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling": op12_spelling}
SQL: dict[str, str] = {}
