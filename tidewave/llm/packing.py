"""Best-fit packing of documents into fixed-length sequences, planned on the histogram of piece lengths.

Every piece longer than a sequence is cut into full sequences and a rest. How pieces combine depends only on how many
there are of each length, so the plan is made from a histogram of at most `capacity` counts: lengths that complete each
other exactly (one, two or three fillers, found by hashing sums) are consumed first, the rest goes by best fit. The plan is
a bounded table of (length, range of ranks) -> (sequence, offset); the pieces get ranks within their length by salted
prefix sums, so no length, however common, meets in one task.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm._common import lean, table, text_or_empty, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of the documents' ids (with `end_id` appended): doc_id, piece, start, length, ids_crc32.

    Null texts count as empty, so they give one piece of the end id. Null and repeated doc_ids pass through.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    @lean
    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        from tidewave.llm import vocab

        encode, end = vocab.encoder(tokenizer).encode_all, np.array([end_id], "<u2").tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, coded in encode(batch.column("text")):
                out: list[tuple] = []
                for doc, packed in zip(ids.slice(a, b - a).to_pylist(), coded, strict=True):
                    wide = np.frombuffer(packed + end, "<u2").astype("<u4")
                    for k, at in enumerate(range(0, len(wide), capacity)):
                        cut = wide[at : at + capacity]
                        out.append((doc, k, at, len(cut), zlib.crc32(cut.tobytes())))
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, PIECES)


class SumIndex:
    """Lengths by their single, pair and triple sums, with the numbers of pieces that are left of each.

    Singles and pairs are hashed by their sum, larger lengths first. A triple of sum s is a length and a pair indexed under
    what it leaves of s. Work depends on the number of distinct lengths (at most the capacity) only.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = Counter({n: c for n, c in counts.items() if c > 0})
        self.lengths = sorted(self.left)
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for i in range(len(self.lengths) - 1, -1, -1):
            a = self.lengths[i]
            for b in self.lengths[: bisect.bisect_right(self.lengths, min(a, capacity - a))]:
                self.pairs.setdefault(a + b, []).append((a, b))

    def available(self, *lengths: int) -> bool:
        return all(self.left[n] >= k for n, k in Counter(lengths).items())

    def find(self, total: int, largest: int, beside: int) -> tuple[int, ...] | None:
        """One, two or three lengths of at most `largest` that sum to `total` and are left besides one piece of length `beside`."""
        if total <= largest and self.available(total, beside):
            return (total,)
        for a, b in self.pairs.get(total, ()):
            if a <= largest and self.available(a, b, beside):
                return (a, b)
        for c in reversed(self.lengths[: bisect.bisect_right(self.lengths, min(largest, total - 2))]):
            if 3 * c < total:
                break
            if self.left[c]:
                for a, b in self.pairs.get(total - c, ()):
                    if a <= c and self.available(a, b, c, beside):
                        return (c, a, b)
        return None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Use these lengths together as often as the counts allow; how often that was."""
        need = Counter(lengths)
        times = min(self.left[n] // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= times * k
        return times


def plan_bins(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """How to fill bins: (lengths in a bin, number of such bins). Work and result depend on the number of distinct lengths only.

    Longest lengths first: those with an exact complement among single, pair and triple sums are consumed as often as the
    counts allow. What remains is packed by best fit, longest first, whole groups of equal bins at a time.
    """
    index = SumIndex(histogram, capacity)
    done: list[tuple[tuple[int, ...], int]] = []
    rest: Counter = Counter()
    for length in reversed(index.lengths):
        while index.left[length] > 0:
            fill = () if length == capacity else index.find(capacity - length, length, length)
            if fill is None:
                rest[length] = index.left.pop(length)
                break
            done.append(((length, *fill), index.take((length, *fill))))
    groups: dict[tuple[int, ...], int] = {}
    room: list[tuple[int, tuple[int, ...]]] = []  # sorted: free space and contents of a group of equal bins

    def put(free: int, bin_: tuple[int, ...], count: int) -> None:
        if count:
            if bin_ not in groups:
                bisect.insort(room, (free, bin_))
            groups[bin_] = groups.get(bin_, 0) + count

    for length in sorted(rest, reverse=True):
        count = rest[length]
        while count:
            at = bisect.bisect_left(room, (length, ()))
            free, bin_ = room.pop(at) if at < len(room) else (capacity, ())
            bins = groups.pop(bin_, count)
            each = free // length  # best fit stays with a bin while the length still fits it
            full = min(bins, count // each)
            put(free - each * length, bin_ + (length,) * each, full)
            count -= full * each
            bins -= full
            if bin_ and bins and count:  # the last, partly filled bin of the group
                put(free - count * length, bin_ + (length,) * count, 1)
                count, bins = 0, bins - 1
            elif not bin_ and count and count < each:
                put(free - count * length, (length,) * count, 1)
                count = 0
            if bin_:
                put(free, bin_, bins)
    return done + list(groups.items())


def placements(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """The plan as (length, first rank, first sequence, offset), in order of length and rank: the r-th piece of a length goes
    to sequence first + (r - first rank) of the last row that starts at or before r."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, bins in plan:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += bins
            offset += n
        sequence += bins
    return sorted(rows)


def pack(pieces: DataFrame, capacity: int = 2048, salt_rows: int = 100_000) -> DataFrame:
    """Give every row of `pieces` (length between 1 and `capacity`) a sequence_id and an offset.

    `pieces` must be a written table with a number `mix` that tells its rows apart (equal rows too), as it is read more than
    once. Salts per length follow the counts: about `salt_rows` rows to a salt. The histogram (at most `capacity` rows) and the plan made of it are all that the driver sees.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max([1, *(-(-n // salt_rows) for n in histogram.values())])
    keyed = pieces.withColumn("_salt", F.pmod("mix", F.lit(max(salts, 8))))
    by_salt = keyed.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    first = by_salt.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy("mix", "doc_id", "piece")
    ranked = keyed.withColumn("_in", F.row_number().over(within)).join(first, ["length", "_salt"]).withColumn("rank", F.col("_first") + F.col("_in") - 1)
    plan = spark.sparkContext.broadcast(placements(plan_bins(histogram, capacity)))

    @lean
    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table_ = np.array(plan.value, np.int64).reshape(-1, 4)
        starts = (table_[:, 0] << 44) + table_[:, 1]
        for batch in batches:
            rank = np.asarray(batch.column("rank")).astype(np.int64)
            row = np.searchsorted(starts, (np.asarray(batch.column("length")).astype(np.int64) << 44) + rank, side="right") - 1
            got = table_[row] if len(row) else table_[:0]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(got[:, 2] + rank - got[:, 1]), pa.array(got[:, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their places. An empty table gives no rows."""
    pieces = token_pieces(docs, tokenizer, capacity).withColumn("mix", F.xxhash64(F.monotonically_increasing_id()))
    return pack(written(pieces, "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_packing": op4_packing}
SQL: dict[str, str] = {}
