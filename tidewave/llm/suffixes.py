"""Exact removal of repeated substrings with range-partitioned, sampled suffixes.

Every 100-byte string ("window") picks one suffix that starts inside it: the one whose first 20 bytes hash lowest, leftmost
on ties. Equal windows pick it at the same offset, so windows can only be equal if they share those leading bytes. A run of
windows with the same suffix is a stretch; per suffix one row goes on: leading bytes, digest of the stretch, place.

1. Sampled splitters range-partition the rows by leading bytes, then digest, then place. Each bucket is sorted by a multikey
   quicksort and adjacent rows are compared, also across bucket boundaries. A stretch that equals an earlier one is removed
   whole. Stretches that share leading bytes with a different stretch go on; the rest has no repeats.
2. Of those the bytes are fetched. Per leading bytes, the multikey quicksort orders their windows; a window that equals one of
   an earlier place is removed. Where so many different stretches share leading bytes that they would make one large group,
   their windows are range-partitioned by their bytes and place and compared with their neighbours like the rows of step 1.

Windows are compared by their bytes, whole stretches by 128-bit digests with a seed drawn anew for every run.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewave.llm._common import discard, free_names, lean, table, text_or_empty, worker_cache, written

LEAD = 20  # leading bytes of a sampled suffix
CHUNK = 1 << 20  # windows of longer texts are taken in runs of so many

LEADING = ["a", "b", "c"]  # the leading bytes as numbers in their order
ORDER = [*LEADING, "d1", "d2", "doc", "start"]
ROW = "a long, b long, c int, d1 long, d2 long, doc long, start long, width int, back int"
SMALL = 2048  # rows of a part that the quicksort leaves to a plain sort


def _powers():
    """A table of values for bytes, powers of an odd base modulo 2^64 and powers of its inverse: what ranks leading bytes."""
    import numpy as np

    def make():
        n, base = CHUNK + 4096, 0x9E3779B97F4A7C15
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.random.default_rng(20).integers(0, 1 << 62, 256, dtype=np.uint64) * 2 + 1, np.cumprod(up), np.cumprod(down)

    return worker_cache(("powers", CHUNK), make)


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words_of(data):
    """The 8 bytes from every place on as one number whose order is that of the bytes; zeros follow the end."""
    import numpy as np

    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.zeros(len(data) + 8, np.uint64)
    for k in range(8):
        out |= wide[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def signed(words):
    """Unsigned 64-bit numbers as signed ones in the same order."""
    import numpy as np

    return (words ^ np.uint64(1 << 63)).view(np.int64)


def multikey_sort(n: int, depths: int, key):
    """Order of n rows by `depths` words and the group of each place in it (rows equal in all words share one).

    A multikey quicksort: a part of the rows that agree in their first words is divided by the next word of a pivot into
    less, equal and greater; the equal part goes on with the word after. All parts are divided at once; `key(depths, rows)` gives
    the words. Parts of up to SMALL rows are sorted plainly, a word at a time.
    """
    import numpy as np

    order, begins = np.arange(n), np.ones(n, bool)
    lo, size, depth = np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)
    rest: list[tuple] = []
    while len(lo):
        whole = (depth == depths) & (size > 1)
        for a, m in zip(lo[whole].tolist(), size[whole].tolist(), strict=True):
            begins[a + 1 : a + m] = False
        few = ~whole & (size > 1) & (size <= SMALL)
        rest.append((lo[few], size[few], depth[few]))
        big = ~whole & (size > SMALL)
        lo, size, depth = lo[big], size[big], depth[big]
        if not len(lo):
            break
        first = np.cumsum(size) - size
        part = np.repeat(np.arange(len(lo)), size)
        local = np.arange(len(part)) - first[part]
        rows = order[lo[part] + local]
        v = key(depth[part], rows)
        x, y, z = v[first], v[first + size // 2], v[first + size - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[part]
        less, equal = v < pivot, v == pivot
        n_less, n_equal = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(equal, first, dtype=np.int64)
        before_less, before_equal = np.cumsum(less) - less, np.cumsum(equal) - equal
        before_less -= before_less[first][part]
        before_equal -= before_equal[first][part]
        above = (n_less + n_equal)[part] + local - before_less - before_equal
        order[lo[part] + np.where(less, before_less, np.where(equal, n_less[part] + before_equal, above))] = rows
        lo, size, depth = np.concatenate([lo, lo + n_less, lo + n_less + n_equal]), np.concatenate([n_less, n_equal, size - n_less - n_equal]), np.concatenate([depth, depth + 1, depth])
    lo, size, depth = (np.concatenate(c) for c in zip(*rest, strict=True))
    while len(lo):
        first = np.cumsum(size) - size
        part = np.repeat(np.arange(len(lo)), size)
        at = lo[part] + np.arange(len(part)) - first[part]
        rows = order[at]
        v = key(depth[part], rows)
        by = np.lexsort((v, part))
        order[at], v = rows[by], v[by]
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (v[1:] != v[:-1])])
        head = np.flatnonzero(new)
        lo, size, depth = at[head], np.diff(np.append(head, len(at))), depth[part[head]] + 1
        for a, m in zip(lo[(depth == depths) & (size > 1)].tolist(), size[(depth == depths) & (size > 1)].tolist(), strict=True):
            begins[a + 1 : a + m] = False
        more = (size > 1) & (depth < depths)
        lo, size, depth = lo[more], size[more], depth[more]
    return order, np.cumsum(begins) - 1


def small(batches: Iterator, rows: int = 256) -> Iterator:
    """Batches cut to a few hundred rows, so that Python objects are made of few texts and lists at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sliding_min(x, w: int):
    import numpy as np

    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    rest = w - n
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stretches(data, length: int = 100):
    """Sampled suffixes of a text (array of bytes): the place of each, start and width of its run of windows. Texts shorter than
    a window have none."""
    import numpy as np

    parts, span = [], length - LEAD + 1
    letter, up, down = _powers()
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        cut = data[at : at + CHUNK + length - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter[cut] * up[: len(cut)])])
        rank = _mix((sums[LEAD:] - sums[:-LEAD]) * down[: len(cut) - LEAD + 1])
        best = _sliding_min((rank & ~np.uint64(0xFFFFFF)) | np.arange(len(rank), dtype=np.uint64), span)
        suffix = (best & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]]))
        parts.append((suffix[start] + at, start + at, np.diff(np.append(start, len(suffix)))))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _suffix_rows(docs: DataFrame, length: int, splitters: list[tuple] | None, seed: int) -> DataFrame:
    """Rows of all texts of `docs` (_key, text), with the bucket of each if there are splitters."""
    shared = docs.sparkSession.sparkContext.broadcast(splitters) if splitters is not None else None

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from tidewave.llm.suffixes import ORDER, bucket_of, signed, stretches, words_of

        cuts = np.array(shared.value, np.int64).reshape(-1, len(ORDER)) if shared else None
        digest = xxhash.xxh3_128_digest
        for batch in small(batches, 64):
            owner, places, starts, widths, digests, leads, base = [], [], [], [], [], [], 0
            for key, t in zip(batch.column("_key").to_pylist(), batch.column("text"), strict=True):
                buffer = t.as_buffer()
                data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
                place, start, width = stretches(data, length)
                if not len(place):
                    continue
                text = data.tobytes()
                # What the digest covers is the stretch and where its suffix stands in it.
                digests += [digest(text[a:b], seed + k) for a, b, k in zip(start.tolist(), (start + width + length - 1).tolist(), (place - start).tolist(), strict=True)]
                word = words_of(data)
                leads.append(np.stack([word[place], word[place + 8], word[place + 16] >> np.uint64(32)]))
                owner.append(np.full(len(place), key, np.int64))
                places.append(place - start)
                starts.append(start)
                widths.append(width)
            if not owner:
                continue
            a, b, c = np.concatenate(leads, axis=1)
            two = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            order = [signed(a), signed(b), (c.astype(np.int64) - (1 << 31)), two[:, 0], two[:, 1], np.concatenate(owner), np.concatenate(starts)]
            cols = [*order[:2], order[2].astype(np.int32), *order[3:], np.concatenate(widths).astype(np.int32), np.concatenate(places).astype(np.int32)]
            if shared:
                cols.append(bucket_of(cuts, order).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], [*ORDER, "width", "back", *["bucket"] * bool(shared)])

    return docs.select("_key", F.col("text")).mapInArrow(run, ROW + ", bucket int" * bool(shared))


def bucket_of(cuts, columns):
    """Number of splitters (rows of `cuts`, ascending) that are not after each row of `columns`."""
    import numpy as np

    low, high = np.searchsorted(cuts[:, 0], columns[0]), np.searchsorted(cuts[:, 0], columns[0], side="right")
    out = low.copy()
    tied = np.flatnonzero(high > low)
    for k in range(int((high - low).max(initial=0))):
        rows = tied[low[tied] + k < high[tied]]
        cut = cuts[low[rows] + k]
        before, equal = np.zeros(len(rows), bool), np.ones(len(rows), bool)
        for c, v in enumerate(columns[1:], 1):
            before |= equal & (cut[:, c] < v[rows])
            equal &= cut[:, c] == v[rows]
        out[rows] += before | equal
    return out


def _adjacent(rows: DataFrame) -> DataFrame:
    """Sort each bucket and compare neighbours: repeat (equals an earlier row of the bucket) or not; rows that differ from all
    others in their leading bytes are left out, unless they touch the end of a bucket. A task holds one bucket of rows."""

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm.suffixes import LEADING, ORDER, multikey_sort

        names = [*ORDER, "width", "back"]
        got = [[np.asarray(b.column(c)) for c in names] for b in batches if b.num_rows]
        if not got:
            return
        columns = {c: np.concatenate(v) for c, v in zip(names, zip(*got, strict=True), strict=True)}
        got = None
        table_ = np.stack([columns[c].astype(np.int64) for c in ORDER])
        order, _ = multikey_sort(table_.shape[1], len(ORDER), lambda depth, r: table_[depth, r])
        columns = {c: v[order] for c, v in columns.items()}
        differs = lambda names: np.concatenate([[True], np.any([columns[c][1:] != columns[c][:-1] for c in names], axis=0)])
        new_lead, new_body = differs(LEADING), differs([*LEADING, "d1", "d2", "width"])
        first = np.flatnonzero(new_body)[np.cumsum(new_body) - 1]
        repeat = (columns["doc"] != columns["doc"][first]) | (columns["start"] != columns["start"][first])
        group = np.cumsum(new_lead) - 1
        bodies = np.bincount(group, weights=new_body)
        touches = (group == 0) | (group == group[-1])
        keep = np.flatnonzero(repeat | ((bodies[group] > 1) | touches) & new_body)
        for a in range(0, len(keep), 100_000):
            k = keep[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(columns[c][k]) for c in names), pa.array(repeat[k])], [*names, "repeat"])

    return rows.mapInArrow(run, ROW + ", repeat boolean")


def _settle(found: DataFrame, *same: str) -> DataFrame:
    """Compare across bucket boundaries: of the first rows that several buckets hold for one value of `same`, only the least
    stays. There is at most one per bucket."""
    firsts = found.where("not repeat")
    order = Window.partitionBy(*same).orderBy("doc", "start")
    least = firsts.withColumn("_d", F.first("doc").over(order)).withColumn("_s", F.first("start").over(order))
    return least.withColumn("repeat", (F.col("doc") != F.col("_d")) | (F.col("start") != F.col("_s"))).drop("_d", "_s")


def equal_windows(lead, doc, start, back, texts: list[bytes], length: int = 100):
    """Which windows of these stretches equal one of an earlier place: stretch number, window number, for every such window.

    Windows are sorted by lead and distance to the suffix, then by their bytes, 8 at a time.
    """
    import numpy as np

    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    word, width = words_of(data), size - length + 1
    owner = np.repeat(np.arange(len(texts)), width)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
    place, group = (np.cumsum(size) - size)[owner] + number, (lead[owner] * 4096 + back[owner] - number).astype(np.int64)
    # Windows alone in their group need no sorting.
    _, code, many = np.unique(group, return_inverse=True, return_counts=True)
    alive = np.flatnonzero(many[code] > 1)
    place, code = place[alive], code[alive].astype(np.uint64)
    last = -(-length // 8)
    mask = np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (8 * last - length))) & 0xFFFFFFFFFFFFFFFF)

    def key(depth, rows):
        v = word[place[rows] + np.maximum(depth - 1, 0) * 8]
        return np.where(depth == 0, code[rows], np.where(depth == last, v & mask, v))

    order, same = multikey_sort(len(alive), last + 1, key)
    rows = alive[order]
    d, s = doc[owner[rows]], start[owner[rows]] + number[rows]
    by = np.lexsort((s, d, same))
    rows, same, d, s = rows[by], same[by], d[by], s[by]
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))[np.cumsum(np.concatenate([[False], same[1:] != same[:-1]]))] if len(rows) else rows
    later = np.sort(rows[(d != d[first]) | (s != s[first])])
    return owner[later], number[later]


def _local_spans(fetched: DataFrame, length: int) -> DataFrame:
    """Spans (doc, begin, end) of repeated windows among fetched stretches, group by group of leading bytes."""

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm.suffixes import equal_windows, small

        def spans(rows: list[tuple]):
            doc, start, back = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[1:4])
            lead = np.cumsum([False, *(x[0] != y[0] for x, y in zip(rows, rows[1:], strict=False))])
            owner, number = equal_windows(lead, doc, start, back, [r[4] for r in rows], length)
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (number[1:] != number[:-1] + 1)])) if len(owner) else owner
            last = np.concatenate([new[1:], [len(owner)]]) - 1 if len(owner) else owner
            begin = start[owner[new]] + number[new]
            return pa.RecordBatch.from_arrays([pa.array(doc[owner[new]]), pa.array(begin), pa.array(begin + number[last] - number[new] + length)], ["doc", "begin", "end"])

        held: list[tuple] = []
        held_bytes = 0
        for batch in small(batches):
            leads = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "c")), strict=True)
            for row in zip(leads, *(batch.column(c).to_pylist() for c in ("doc", "start", "back", "bytes")), strict=True):
                if held_bytes > 1_000_000 and row[0] != held[-1][0]:
                    yield spans(held)
                    held, held_bytes = [], 0
                held.append(row)
                held_bytes += len(row[4])
        if held:
            yield spans(held)

    return fetched.repartition("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(run, "doc long, begin long, end long")


def _fetch(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """`places` (a, b, c, common, doc, start, width, back) with the bytes of each stretch."""
    wanted = places.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("a", "b", "c", "common", "start", "width", "back")).alias("_places"))
    joined = docs.select("_key", "text").join(wanted, F.col("_key") == F.col("_doc")).select("_key", "text", "_places")

    @lean
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tidewave.llm.suffixes import small

        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in small(batches):
            for key, text, places in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist(), batch.column("_places").to_pylist(), strict=True):
                data = text.encode("utf-8")
                got = [(p["a"], p["b"], p["c"], p["common"], key, p["start"], p["back"], cut) for p in places if len(cut := data[p["start"] : p["start"] + p["width"] + length - 1]) >= length]
                cols = list(zip(*got, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["a", "b", "c", "common", "doc", "start", "back", "bytes"])

    return joined.mapInArrow(run, "a long, b long, c int, common boolean, doc long, start long, back int, bytes binary")


def _window_rows(fetched: DataFrame, length: int) -> DataFrame:
    """Every window of fetched stretches: window (its bytes), doc, start."""

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm.suffixes import small

        for batch in small(batches):
            for doc, start, cut in zip(*(batch.column(c).to_pylist() for c in ("doc", "start", "bytes")), strict=True):
                n = len(cut) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([cut[i : i + length] for i in range(n)], pa.binary()), pa.array(np.full(n, doc, np.int64)), pa.array(start + np.arange(n))], ["window", "doc", "start"])

    return fetched.mapInArrow(run, "window binary, doc long, start long")


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """doc, start of the windows that equal one of an earlier place: neighbours in ranges of windows, also across their ends."""

    @lean
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            window = batch.column("window")
            shifted = pa.concat_arrays([pa.array([before], window.type), window.slice(0, len(window) - 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.fill_null(pc.equal(window, shifted), False)], [*batch.schema.names, "repeat"])
            before = window[-1].as_py()

    order = ["window", "doc", "start"]
    sorted_ = windows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(sorted_.mapInArrow(run, "window binary, doc long, start long, repeat boolean"), "windows")  # both readers need the same ranges
    out = written(ranged.where("repeat").select("doc", "start").union(_settle(ranged, "window").where("repeat").select("doc", "start")), "again")
    discard(ranged)
    return out


def _sampled_suffixes(texts: DataFrame, length: int, seed: int, most: int = 200_000) -> tuple[list[tuple], float]:
    """Ascending suffix rows of `texts`, about `most` of them at most however long the texts are, and about how many rows
    there are; (length - LEAD) / 2 bytes have one suffix on average, so the share follows from the bytes."""
    expected = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 / (length - LEAD)
    rows = _suffix_rows(texts, length, None, seed).select(*ORDER)
    return sorted(tuple(r) for r in rows.sample(min(1.0, most / max(1.0, expected)), seed=6).collect()), expected


def repeated_spans(docs: DataFrame, length: int = 100, hot: int | None = None, sample_rows: int = 2000, bucket_rows: int = 1_000_000) -> DataFrame:
    """Spans (doc, begin, end) that cover just the bytes of windows that also start earlier; they may overlap.

    `docs` has _key (a number of its own for every row, in the order of rows) and text without nulls. Splitters come from about `sample_rows` texts
    and make buckets of about `bucket_rows` rows at most. Leading bytes are common if they have over `hot` different stretches:
    by default a quarter of a partition's share.
    """
    spark = docs.sparkSession
    total = max(1, docs.count())
    share = min(1.0, sample_rows / total)
    seed = random.SystemRandom().getrandbits(62)
    few, rows_of_sample = _sampled_suffixes(docs.sample(share, seed=5), length, seed)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows_of_sample / share / bucket_rows))
    splitters = [few[len(few) * i // buckets] for i in range(1, buckets)] if few else []
    rows = _suffix_rows(docs, length, splitters, seed).repartitionById(buckets, F.col("bucket")).drop("bucket")
    found = written(_adjacent(rows), "stretches")
    settled = written(_settle(found, *LEADING, "d1", "d2", "width"), "firsts")

    per_lead = settled.where("not repeat").groupBy(*LEADING).agg(F.count("*").alias("bodies")).where("bodies > 1")
    if hot is None:
        hot = (per_lead.agg(F.sum("bodies")).first()[0] or 0) // (4 * buckets) + 1
    mixed = settled.where("not repeat").join(per_lead, LEADING).withColumn("common", F.col("bodies") > hot)
    whole = found.where("repeat").select("doc", "start", "width").union(settled.where("repeat").select("doc", "start", "width"))
    spans = whole.select("doc", F.col("start").alias("begin"), (F.col("start") + F.col("width") + length - 1).alias("end"))
    fetched = written(_fetch(docs, mixed, length), "fetched")
    spans = spans.union(_local_spans(fetched.where("not common"), length))
    again = _repeated_windows(_window_rows(fetched.where("common"), length))
    spans = spans.union(again.select("doc", F.col("start").alias("begin"), (F.col("start") + length).alias("end")))
    out = written(spans, "spans")
    discard(found, settled, fetched, again)
    return out


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with a number of its own for every row, in order of doc_id (null first). Where all ids are whole and distinct that is the doc_id;
    else rows are ordered by doc_id and the hash of their text, and written with their numbers."""
    ids = F.col("doc_id").cast("long")
    if docs.where(ids.isNull()).isEmpty() and docs.groupBy(ids.alias("id")).count().where("count > 1").isEmpty():
        return docs.withColumn(key, ids)
    (tie,) = free_names(docs, "_tie")
    order = [ids.asc_nulls_first(), F.col(tie)]
    sorted_ = docs.withColumn(tie, F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(sorted_.drop(tie).withColumn(key, F.monotonically_increasing_id()), "numbered")


def remove_repeats(docs: DataFrame, length: int = 100, replace_text: bool = False, names: tuple[str, str, str, str] = ("kept", "n_bytes", "n_removed", "n_spans")) -> DataFrame:
    """All columns of `docs` with four more: kept (binary: the bytes that stay), n_bytes, n_removed and n_spans.

    With `replace_text`, text becomes what stays, without bytes that no longer form a character, and kept is null.

    A byte goes if a `length`-byte string over it also starts earlier: in an earlier row, or in the same row further left. Rows are
    in order of doc_id, a null doc_id first; rows that share a doc_id (or have none) are texts of their own, in order of a hash
    of the text, so that of rows that repeat each other one stays whole. Null texts count as empty. Texts shorter than `length` keep all bytes. An
    empty table gives no rows. Columns of `docs` that have one of the `names` are replaced; others may have any name.
    """
    docs = docs.drop(*names)
    key, spans_, doc = free_names(docs, "_key", "_spans", "_doc")
    keyed = numbered(docs, key).withColumn("text", text_or_empty())
    spans = repeated_spans(keyed.select(F.col(key).alias("_key"), "text"), length)
    # Keys are rows: what is gathered here is bounded by the row's own text.
    spans = spans.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("begin", "end")).alias(spans_))
    joined = keyed.join(spans, F.col(key) == F.col(doc), "left").select(*docs.columns, spans_)
    more = [F.lit(b"").cast("binary").alias(names[0]), *(F.lit(0).cast("long").alias(c) for c in names[1:])]
    schema = StructType([StructField(f.name, f.dataType) for f in joined.drop(spans_).select("*", *more).schema])

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm.suffixes import small

        for batch in small(batches):
            kept, sizes, removed, runs = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(spans_).to_pylist(), strict=True):
                data = text.encode("utf-8")
                n = len(data)
                if spans:
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, np.minimum([s["begin"] for s in spans], n), 1)
                    np.add.at(step, np.minimum([s["end"] for s in spans], n), -1)
                    gone = np.cumsum(step[:-1]) > 0
                    data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                else:
                    runs.append(0)
                kept.append(data)
                sizes.append(n)
                removed.append(n - len(data))
            own = [c for c in batch.schema.names if c != spans_]
            columns = {c: batch.column(c) for c in own}
            if replace_text:
                columns["text"] = pa.array([k.decode("utf-8", errors="ignore") for k in kept], pa.string())
                kept = [None] * len(kept)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs))], names=[*own, *names])

    return joined.mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated 100-byte strings."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
SQL: dict[str, str] = {}
