"""Exact joins of shingle sets by Jaccard similarity through a token-group matrix.

1. Every text becomes a set of shingle hashes; texts of equal sets are one set from here on. With the shingles of all sets in
   one common order (rare ones first), two sets of similarity t or more share a shingle of their prefixes: the smaller needs the first
   n - ceil(2t/(1+t) n) + 1 of its n shingles, the larger the first n - ceil(t n) + 1.
2. Sets with few shingles before a shared one are central: copies are joined with the most central set of a prefix shingle, one
   comparison a set and round, so that a large group of copies costs no pairs.
3. The matrix: sets of like size and equal min-hashes form groups. A row is a shingle of a group's union of prefixes, with the sizes
   of its sets and the most shingles that follow. A query meets a group only where both may still reach the similarity: the first
   common shingle bounds the overlap by what follows it, so each side names the sizes it can be similar to, and rows join by
   shingle, size class of the group and size class of the query. Queries and groups that are joined already do not meet.
4. For these, the union of the bit signatures of a group bounds the query's overlap with all its sets. Only groups that
   qualify are opened; signatures bound the pairs (of large sets, wider ones, too), and the whole texts decide.

No step has a cap: the order, the maps and the groups only decide how much is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import discard, lean, table, text_or_empty, written
from tidewave.llm.chunks import text_slices
from tidewave.llm.graph import components

#: 64-bit words of a set's signature: bit h mod (64 WORDS) is set for every shingle hash h.
WORDS = 32
#: Bits of the largest map that is sent to tasks (8 MB); a full map only lets more rows through.
MOST_BITS = 1 << 26
#: Keys that are sent to tasks as they are; a map of bits stands for more.
SMALL = 10_000
#: Sets of a group of the matrix, about, where their min-hashes do not tell them apart.
MEMBERS = 64
#: Size classes between a size and the least similar one.
CLASSES = 4


class Rule(NamedTuple):
    """Texts link where under * |intersection| >= over * |union| of their sets of `shingle`-word shingles."""

    shingle: int = 3
    over: int = 90
    under: int = 100

    def size_class(self, n: Column) -> Column:
        return F.floor(F.ln(n.cast("double")) * (CLASSES / math.log(self.under / self.over))).cast("int")

    def alike(self, both: Column, n_a: Column, n_b: Column) -> Column:
        """Whether an overlap (or a bound of it) is enough."""
        return (self.over + self.under) * both >= self.over * (n_a + n_b)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _mixed(x):
    """64-bit numbers mixed one to one, in place, so that each bit depends on all."""
    import numpy as np

    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts):
    """64-bit hashes of the words of an Arrow string array without nulls (A-Z in lower case, split at ASCII white space), all in order, and the ends of
    the texts among them (one more than texts, from 0). Words are taken eight bytes at a time, all of them at once."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    texts = texts.cast(pa.large_string())
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    text = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    text = text | (text - np.uint8(65) < 26).view(np.uint8) << 5
    cuts = cuts - cuts[0]
    letter = (text != 32) & (text - np.uint8(9) > 4)
    first, last = letter.copy(), letter.copy()  # a letter after or before white space or an end of its text
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    begins, ends = cuts[:-1][cuts[:-1] < len(text)], cuts[1:][cuts[1:] > 0] - 1
    first[begins], last[ends] = letter[begins], letter[ends]
    at = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - at
    eights = np.zeros(len(text) // 8 + 2, "<u8")
    eights.view(np.uint8)[: len(text)] = text
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    todo = np.flatnonzero(size <= LONG_WORD)
    begin, left = at[todo], size[todo]
    while len(todo):
        q, r = begin >> 3, ((begin & 7) << 3).astype(np.uint64)
        piece = (eights[q] >> r) | (eights[q + 1] << np.uint64(1) << (np.uint64(63) - r))
        piece &= masks[np.minimum(left, 8)]
        out[todo] = _mixed(out[todo] ^ piece)
        more = left > 8
        todo, begin, left = todo[more], begin[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(text[at[i] : at[i] + size[i]], 42)
    return out, np.searchsorted(at, cuts)


def shingle_sets(texts, shingle: int) -> list:
    """Ascending distinct 64-bit hashes of the shingles of each text of an Arrow string array without nulls: of `shingle` words, or of all where there are fewer (none:
    no shingles)."""
    import numpy as np

    words, ends = word_hashes(texts)

    def joined(x, width):
        h = x[: max(0, len(x) - width + 1)].copy()
        for i in range(1, width):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += x[i : i + len(h)]
        return _mixed(h)

    every, out, ends = joined(words, shingle), [], ends.tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        x = np.sort(every[a : b - shingle + 1] if b - a >= shingle else joined(words[a:b], b - a) if b > a else words[:0])
        fresh = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=fresh[1:])
        out.append(x[fresh])
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), k (what tells rows apart by both)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumn("k", F.xxhash64("doc_id", "text"))


def with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose number of the name of the only column of `keys`, a written table of distinct numbers, is in it, and some others where there are many keys. No
    row is shuffled: few keys are sent to the tasks; a map of bits that is bounded in size stands for many. Only the number goes through Python for it."""
    (name,) = keys.columns
    if keys.count() <= SMALL:
        return rows.join(F.broadcast(keys), name, "left_semi").select(*rows.columns)
    shared = rows.sparkSession.sparkContext.broadcast(bit_map(keys))

    @F.pandas_udf("boolean")
    def taken(k: pd.Series) -> pd.Series:
        return pd.Series(in_map(shared.value, k.to_numpy()))

    return rows.where(taken(name))


def rows_with(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (see `_rows`) whose k is in `keys`, and maybe some others (see `with_keys`)."""
    return with_keys(_rows(docs), keys)


def bit_map(numbers: DataFrame, each: int = 256) -> tuple:
    """(bits, packed map): bit x mod bits is set for every x of a column of numbers. The map has some `each` bits for each of them, and
    at most MOST_BITS."""
    import numpy as np

    x = F.col(numbers.columns[0]).cast("long")
    bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, (each * numbers.count()).bit_length()))
    at = F.pmod(x, F.lit(bits))
    words = numbers.select(F.shiftright(at, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    packed = np.zeros(bits // 64, np.int64)
    packed[np.asarray(got.column("w"))] = np.asarray(got.column("b"))
    return bits, packed


def in_map(known: tuple, x):
    """Which numbers of an array may be in a map of `bit_map`."""
    import numpy as np

    bits, packed = known
    at = x.astype(np.int64) & (bits - 1)
    return (packed[at >> 6] >> (at & 63)) & 1 == 1


def common_shingles(docs: DataFrame, shingle: int, sample_rows: int = 2_000, most: int = 200_000) -> tuple:
    """Shingles in at least 3 of about `sample_rows` texts, ascending, and their counts; the driver sees at most `most`. They only
    serve to put common shingles last."""
    import numpy as np

    rows = _rows(docs)
    share = min(1 << 20, -(-sample_rows * (1 << 20) // max(1, docs.count())))

    @lean
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b in text_slices(batch.column("text"), 1 << 20):
                sets = shingle_sets(batch.column("text").slice(a, b - a), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view("<i8"))], ["t"])

    sample = rows.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < share).select("text").distinct().mapInArrow(run, "t long")
    found = sample.groupBy("t").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "t").limit(most).toArrow()
    t, n = np.asarray(found.column("t")), np.asarray(found.column("n"))
    order = np.argsort(t)
    return t[order], n[order]


def prefix_rows(rows: DataFrame, common: tuple, rule: Rule, late: tuple = (), simhash: bool = False, bare: bool = False) -> DataFrame:
    """Per row: doc_id, k, s (hash of the set), fp (SimHash of the set if `simhash`), n, sig (signature), wide (null, or
    a wider signature of a large set), m (three min-hashes) and prefix: 32 bits of each of the first
    shingles in the common order, as many as a query needs. Null texts count as empty. `late`: maps of shingles that come last. `bare`: k and prefix alone."""
    shared = rows.sparkSession.sparkContext.broadcast((*common, late))
    over, under = rule.over, rule.under

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from tidewave.llm.simhash import fingerprint_of

        names, counts, late = shared.value
        odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
        few = np.zeros(1 << 20, bool)  # which low bits of a hash any of the names has
        few[names & ((1 << 20) - 1)] = True

        def ranks(x):
            """Places of hashes in the order, and their 32 bits."""
            t, short = x.view("<i8"), (x >> np.uint64(32)).astype(np.uint32).view(np.int32)
            rank = np.zeros(len(t), np.int64)
            some = np.flatnonzero(few[t & ((1 << 20) - 1)])
            if len(some):
                at = np.minimum(np.searchsorted(names, t[some]), len(names) - 1)
                rank[some] = np.where(names[at] == t[some], counts[at], 0)
            for known in late:
                rank += in_map(known, short).astype(np.int64) << 40
            return rank, short

        def first(rank, short):
            """The prefix: equal ranks stay in the order of the hashes."""
            length = len(rank) - (over * len(rank) + under - 1) // under + 1 if len(rank) else 0
            rare = np.flatnonzero(rank == 0)
            return short[rare[:length] if len(rare) >= length else np.argsort(rank, kind="stable")[:length]]

        def signature(x, words=WORDS):
            bits = np.zeros(64 * words, np.uint8)
            bits[x & np.uint64(64 * words - 1)] = 1
            return np.packbits(bits, bitorder="little").view("<i8")

        def wider(x):
            """Two to four bits a shingle, where the signature has less."""
            return signature(x, 1 << ((len(x) - 1) // 32).bit_length()) if len(x) > 32 * WORDS else None

        def least(x, ends):
            """Three min-hashes of each of the sets that end there; 0 for empty ones."""
            out, full = np.zeros((len(ends) - 1, 3), np.uint32), ends[1:] > ends[:-1]
            for i, m in enumerate(odd):
                out[full, i] = np.minimum.reduceat((x * m >> np.uint64(32)).astype(np.uint32), ends[:-1][full]) if len(x) else 0
            return out.view(np.int32).ravel()

        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        for batch in batches:
            for a, b in text_slices(batch.column("text"), 1 << 20):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column("text"), rule.shingle)
                every, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
                rank, short = ranks(every)
                prefix = [first(rank[i:j], short[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                prefixes = lists(np.cumsum([0, *map(len, prefix)]), np.concatenate(prefix))
                if bare:
                    yield pa.RecordBatch.from_arrays([part.column("k"), prefixes], ["k", "prefix"])
                    continue
                s = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], "<u8").view("<i8")
                fp = pa.array(np.array([fingerprint_of(x) for x in sets], "<u8").view("<i8")) if simhash else pa.nulls(len(sets), pa.int64())
                sigs = lists(np.arange(len(sets) + 1) * WORDS, np.concatenate([signature(x) for x in sets]))
                columns = [part.column("doc_id"), part.column("k"), pa.array(s), fp, pa.array([len(x) for x in sets], pa.int32()), sigs]
                columns.append(pa.array([wider(x) for x in sets], pa.list_(pa.int64())))
                columns += [lists(np.arange(len(sets) + 1) * 3, least(every, ends)), prefixes]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "s", "fp", "n", "sig", "wide", "m", "prefix"])

    if bare:
        return rows.mapInArrow(run, "k long, prefix array<int>")
    return rows.mapInArrow(run, "doc_id long, k long, s long, fp long, n int, sig array<long>, wide array<long>, m array<int>, prefix array<int>")


def touched(distinct: DataFrame, late: tuple) -> DataFrame:
    """k of the sets whose prefix holds a shingle of the map."""
    shared = distinct.sparkSession.sparkContext.broadcast(late)

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("prefix")
            hits = np.append(0, np.cumsum(in_map(shared.value, np.asarray(lists.flatten())), dtype=np.int64))
            ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            yield batch.select(["k"]).filter(pa.array(hits[ends[1:]] > hits[ends[:-1]]))

    return distinct.select("k", "prefix").mapInArrow(run, "k long")


def thinned(docs: DataFrame, distinct: DataFrame, common: tuple, rule: Rule, crowd: int, rounds: int) -> DataFrame:
    """s, k, n and prefix of `distinct`, with prefixes in which shingles of over `crowd` prefixes come last. Each round looks at the prefixes of the one
    before and makes those anew that hold such shingles; the others stay as they are in the new order, too (and come out the same where they are made anew
    for nothing). Signatures are left aside, as they would be shuffled each time."""
    late: tuple = ()
    now = distinct.select("s", "k", "n", "prefix", F.lit(True).alias("fresh"))  # fresh: counted in the round, all at first, then those made anew
    for r in range(rounds):
        tokens = now.where("fresh").select(F.explode("prefix").alias("t"))
        crowded = written(tokens.groupBy("t").agg(F.count("*").alias("sets")).where(F.col("sets") > crowd).select("t"), "crowded")
        if crowded.isEmpty():
            discard(crowded)
            break
        late = (*late, bit_map(crowded, 4096))
        hit = written(touched(now, late[-1]), "affected")
        again = prefix_rows(rows_with(docs, hit), common, rule, late, bare=True).groupBy("k").agg(F.first("prefix").alias("again"))
        made = now.drop("fresh").join(again, "k", "left").select("s", "k", "n", F.coalesce("again", "prefix").alias("prefix"), F.col("again").isNotNull().alias("fresh"))
        after = written(made, "thinned")
        discard(crowded, hit, *([now] if r else []))
        now = after
    return now


def _alone(x: Column, y: Column) -> Column:
    """Bits of a signature that another lacks: so many shingles, at least, are in the first set only."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, v: t + v)


def _bound(a: Column, b: Column) -> Column:
    """The most shingles that two sets of n_a and n_b can share by their signatures."""
    return F.least(F.col("n_a") - _alone(a, b), F.col("n_b") - _alone(b, a))


def possible(pairs: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of sets (s, k, n, sig) whose similarity may be enough, by their signatures; with k_a and k_b, n_a and n_b."""
    side = lambda x: known.select(F.col("s").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("k", "n", "sig")])
    may = rule.alike(_bound(F.col("sig_a"), F.col("sig_b")), F.col("n_a"), F.col("n_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b", "k_a", "k_b", "n_a", "n_b")


def likely(pairs: DataFrame, wide: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs that `possible` gives, written, whose similarity may be enough by the wider signatures, too: s, wide of the large sets. The signature of
    a large set has nearly all bits, so that it tells little. Bits h and h + half of the wider one of a pair are one bit of the other."""
    large = pairs.where(F.least("n_a", "n_b") > 32 * WORDS)
    ends = written(large.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "large")
    of = with_keys(wide, ends)
    side = lambda x: of.select(F.col("s").alias(x), F.col("wide").alias(f"wide_{x}"))

    def folded(x: str, y: str) -> Column:
        w, half = F.col(x), F.size(y)
        return F.when(F.size(x) == 2 * half, F.zip_with(F.slice(w, F.lit(1), half), F.slice(w, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(w)

    both = large.join(side("a"), "a").join(side("b"), "b").withColumns({"wide_a": folded("wide_a", "wide_b"), "wide_b": folded("wide_b", "wide_a")})
    bound = rule.alike(_bound(F.col("wide_a"), F.col("wide_b")), F.col("n_a"), F.col("n_b"))
    both = both.where((F.size("wide_a") != F.size("wide_b")) | bound).select(*pairs.columns)
    out = written(pairs.where(F.least("n_a", "n_b") <= 32 * WORDS).union(both), "likely")
    discard(pairs, ends)
    return out


def confirmed(docs: DataFrame, pairs: DataFrame, known: DataFrame, wide: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of sets of `known` that are similar enough by the whole texts, fetched again for these sets. `wide`: s, wide of the large ones."""
    pairs = likely(written(possible(pairs, known, rule), "pairs"), wide, rule)
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ends = written(pairs.select(F.explode(F.array("k_a", "k_b")).alias("k")).distinct(), "ends")
    texts = written(rows_with(docs, ends).join(ends, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text")), "texts")
    side = lambda x: texts.select(F.col("k").alias(f"k_{x}"), F.col("text").alias(f"text_{x}"))

    @lean
    def check(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, of_last = None, None
        for batch in batches:
            keep, keys = np.zeros(batch.num_rows, bool), batch.column("k_b").to_numpy()
            for at, stop in text_slices(batch.column("text_a"), 1 << 20):
                part, k = batch.slice(at, stop - at), keys[at:stop]
                fresh = np.append(k[0] != last, k[1:] != k[:-1])  # rows come in runs of one b
                sets_a, sets_b = shingle_sets(part.column("text_a"), rule.shingle), iter(shingle_sets(part.column("text_b").filter(pa.array(fresh)), rule.shingle))
                for i, (of_a, anew) in enumerate(zip(sets_a, fresh.tolist(), strict=True)):
                    of_last = next(sets_b) if anew else of_last
                    of_both = np.sort(np.concatenate([of_a, of_last]))
                    both = np.count_nonzero(of_both[1:] == of_both[:-1])
                    keep[at + i] = (rule.over + rule.under) * both >= rule.over * (len(of_a) + len(of_last))
                last = k[-1]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    found = pairs.join(side("a"), "k_a").join(side("b"), "k_b").select("a", "b", "k_b", "text_a", "text_b")
    found = written(found.mapInArrow(check, "a long, b long"), "confirmed")
    discard(pairs, ends, texts)
    return found


def grouped(known: DataFrame, rule: Rule) -> DataFrame:
    """s, g, c (size class): sets of one class and equal min-hashes. Where more than MEMBERS sets agree in the first min-hash the second is
    looked at, and where more agree in both they are dealt out by their hash, so that no group is much larger."""
    base = known.select("s", rule.size_class(F.col("n")).alias("c"), F.xxhash64(rule.size_class(F.col("n")), F.col("m")[0]).alias("g1"), F.xxhash64(F.col("m")[1]).alias("m2"))
    one = base.groupBy("g1").agg(F.count("*").alias("n1"))
    finer = base.join(one, "g1").withColumn("g2", F.when(F.col("n1") > MEMBERS, F.xxhash64("g1", "m2")).otherwise(F.col("g1")))
    two = finer.groupBy("g2").agg(F.count("*").alias("n2"))
    dealt = F.pmod(F.xxhash64("s", F.lit("group")), F.ceil(F.col("n2") / MEMBERS))
    return finer.join(two, "g2").select("s", "c", F.when(F.col("n2") > MEMBERS, F.xxhash64("g2", dealt)).otherwise(F.col("g2")).alias("g"))


def star_pairs(lists: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """One pair (a, b) for each set that shares a prefix shingle with a set of another label: with the most central of the sets that stand
    for these shingles."""
    member = lists.join(labels, "s").withColumn("far", (F.col("n") - F.col("rest")) / F.col("n"))
    hub = F.min(F.struct("far", "s", "n", "label")).alias("x")
    mixed = member.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), hub).where("lo <> hi")
    near = member.join(mixed.select("t", F.col("x.s").alias("s2"), F.col("x.far").alias("far2"), F.col("x.n").alias("n2"), F.col("x.label").alias("label2")), "t")
    near = near.where((F.col("label") != F.col("label2")) & (rule.under * F.least("n", "n2") >= rule.over * F.greatest("n", "n2")))
    best = near.groupBy("s").agg(F.min(F.struct("far2", "s2")).alias("x")).select("s", F.col("x.s2").alias("s2"))
    return best.select(F.least("s", "s2").alias("a"), F.greatest("s", "s2").alias("b")).distinct()


def matrix_pairs(lists: DataFrame, known: DataFrame, groups: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of sets of different labels: a query with the members of the groups that it opens."""
    total = rule.over + rule.under
    most = lambda rest: F.floor(rest * total / rule.over)  # noqa: E731  # largest sum of sizes that so much overlap suffices for
    label = F.when(F.min("label") == F.max("label"), F.min("label")).alias("label_g")
    member = groups.join(labels, "s")
    unions = written(
        member.join(known.select("s", "n", "sig"), "s").groupBy("g").agg(label, F.min("n").alias("lo"), F.max("n").alias("hi"), *[F.bit_or(F.col("sig")[i]).alias(f"w{i}") for i in range(WORDS)])
        .select("g", "label_g", "lo", "hi", F.array(*[f"w{i}" for i in range(WORDS)]).alias("sig_g")),
        "unions",
    )
    inside = written(lists.where("indexed").join(member, "s").select("t", "g", "c", F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("label").alias("label2")), "inside")
    rows = inside.groupBy("t", "g", "c").agg(F.min("n2").alias("lo"), F.max("n2").alias("hi"), F.max("rest2").alias("rest_g"))
    rows = rows.withColumn("top", F.least(most(F.col("rest_g")) - F.col("lo"), F.floor(F.col("hi") * rule.under / rule.over))).where("top >= lo")
    rows = rows.join(unions.select("g", "label_g"), "g")
    rows = rows.select("t", "g", F.col("c").alias("bx"), "label_g", "lo", F.col("top").alias("top_g"), F.explode(F.sequence(rule.size_class(F.col("lo")), rule.size_class(F.col("top")))).alias("by"))
    asks = lists.withColumn("low", F.ceil(F.col("n") * rule.over / rule.under)).withColumn("top", F.least("n", most(F.col("rest")) - F.col("n"))).where("top >= low").join(labels, "s")
    asks = asks.select("t", "s", "n", "label", "low", "top", rule.size_class(F.col("n")).alias("by"), F.explode(F.sequence(rule.size_class(F.col("low")), rule.size_class(F.col("top")))).alias("bx"))
    apart = F.col("label_g").isNull() | (F.col("label") != F.col("label_g"))
    met = asks.join(rows, ["t", "bx", "by"]).where(apart & F.col("n").between(F.col("lo"), F.col("top_g")) & (F.col("lo") <= F.col("top"))).select("t", "s", "g", "n", "label", "low", "top")
    met = written(met, "met")
    bound = F.col("n") - _alone(F.col("sig"), F.col("sig_g"))
    opened = met.select("s", "g").distinct().join(known.select("s", "n", "sig"), "s").join(unions, "g").where(rule.alike(bound, F.col("n"), F.col("lo"))).select("s", "g")
    # In an opened group the query meets the sets that the common shingle allows: neither side's rest is too short for both sizes.
    fits = (F.col("label") != F.col("label2")) & F.col("n2").between(F.col("low"), F.col("top")) & (rule.alike(F.col("rest2"), F.col("n"), F.col("n2")))
    pairs = met.join(opened, ["s", "g"]).join(inside, ["t", "g"]).where(fits)
    out = written(pairs.select(F.least("s", "s2").alias("a"), F.greatest("s", "s2").alias("b")).distinct(), "pairs")
    discard(unions, inside, met)
    return out


def similar_sets(docs: DataFrame, distinct: DataFrame, prefixes: DataFrame, rule: Rule, first: DataFrame | None = None, stars: int = 2) -> DataFrame:
    """s, label of those of `distinct` (s, k, fp, n, sig, wide, m; one row per set; `prefixes`: s, n, prefix of them) that have candidates: connected just as all pairs
    that are similar enough would connect them. `first`: a function of these sets that gives pairs to look at first."""
    count = F.col("n") - F.ceil(2 * rule.over * F.col("n") / (rule.over + rule.under)) + 1
    every = prefixes.select("s", "n", count.alias("index"), F.posexplode("prefix").alias("at", "t")).select("s", "n", "t", (F.col("n") - F.col("at")).alias("rest"), (F.col("at") < F.col("index")).alias("indexed"))
    several = every.groupBy("t").agg(F.count("*").alias("sets"), F.max("indexed").alias("any")).where("sets > 1 and any").select("t")
    lists = written(every.join(several, "t"), "lists")
    wide = distinct.where("wide is not null").select("s", "wide")
    known = written(distinct.drop("prefix", "wide").join(lists.select("s").distinct(), "s", "left_semi"), "candidates")
    labels = written(known.select("s", F.col("s").alias("label")), "labels")
    groups = written(grouped(known, rule), "groups")
    for k in range(stars + 1):
        near = star_pairs(lists, labels, rule) if k < stars else matrix_pairs(lists, known, groups, labels, rule)
        links = confirmed(docs, near.union(first(known)).distinct() if first and k == 0 else near, known, wide, rule)
        if not links.isEmpty():
            of = lambda x: labels.select(F.col("s").alias(x), F.col("label").alias(f"label_{x}"))
            joined = components(links.join(of("a"), "a").join(of("b"), "b").select("label_a", "label_b"))
            after = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
            after = written(after.select("s", F.coalesce("least", "label").alias("label")), "labels")
            discard(labels, joined)
            labels = after
            discard(links)
        if k == stars:
            discard(near)
    discard(lists, known, groups)
    return labels


def set_rows(docs: DataFrame, rule: Rule, first=None, crowd: int = 50, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Written tables: doc_id, k, s, n of every row; s, label of every set, where sets have one label if links connect them."""
    common = common_shingles(docs, rule.shingle)
    rows = written(prefix_rows(_rows(docs), common, rule, simhash=first is not None), "prefixes")
    firsts = [F.first(c).alias(c) for c in ("fp", "n", "sig", "wide", "m", "prefix")]
    distinct = written(rows.groupBy("s").agg(F.min("k").alias("k"), *firsts), "distinct")
    prefixes = thinned(docs, distinct, common, rule, crowd, rounds)
    labels = similar_sets(docs, distinct, prefixes, rule, first)
    member = written(distinct.select("s").join(labels, "s", "left").select("s", F.coalesce("label", "s").alias("label")), "members")
    discard(distinct, labels, *([prefixes] if hasattr(prefixes, "written_to") else []))
    return rows.select("doc_id", "k", "s", "n"), member


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (smallest doc_id reachable over links, itself included) of every row.

    Texts of equal sets link. Empty and null texts, and texts without words, have the empty set, link with nothing and are their own
    component. Null doc_ids are never the smallest: a component of null doc_ids only has a null component_id. Repeated rows all come back.
    Other columns of `docs` are not read. An empty table gives no rows.
    """
    rows, member = set_rows(docs, rule)
    least = rows.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("least")).join(member, "s")
    of = least.select("s", "label").join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("s", "component_id")
    out = rows.join(of, "s", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


_SQL = """
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS t
    FROM words
), sized AS (SELECT doc_id, t, len(t) AS n FROM sets),
tokens AS (SELECT doc_id, n, unnest(t) AS t FROM sized),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS k
    FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (n_a + n_b - k)),
reach AS (
    WITH RECURSIVE r(doc_id, c) AS (SELECT doc_id, doc_id FROM sized UNION SELECT l.a, r.c FROM r JOIN links l ON l.b = r.doc_id)
    SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM sized JOIN reach USING (doc_id)
"""

QUERIES = {"op13_jaccard": op13_jaccard}
SQL: dict[str, str] = {"op13_jaccard": _SQL}
