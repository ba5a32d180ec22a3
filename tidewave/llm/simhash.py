"""SimHash near-duplicates linked through BK-trees.

Fingerprints of whole texts are made in one pass. Two of them within r bits agree on at least B - r of B blocks of their
bits, so every distinct fingerprint goes to one shard per choice of B - r blocks, keyed by those bits. In a shard a BK-tree
is built (children keyed by integer Hamming distance to the parent) and every member searches it, following only edges
within the radius of its distance. A shard tree is shuffled to the task that needs it, never through the driver. Members of
crowded shards are sharded anew by more and smaller blocks. On the finest level a shard agrees in all but 12 bits, so it has
at most 4096 members: one huge group of near copies is spread over many small trees, and work grows in proportion to the
rows. A tree emits a spanning forest of its links, not the links, and components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import lean, table, text_or_empty, written
from tidewave.llm.graph import components


def shingle_hashes(text: str, shingle: int = 3, seed: int = 42):
    """XXH64 values of the shingles of a text: words with A-Z in lower case, split at ASCII white space; runs of `shingle` words
    joined by single spaces, repeats included (fewer words: all of them; none: no values)."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    width = min(shingle, len(words))
    begins = (ends - size)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[width - 1 :].tolist(), strict=True)], "<u8")


def fingerprint_of(h) -> int:
    """64-bit SimHash of an array of 64-bit hashes (none: 0): a bit is set if it is in over half of them."""
    import numpy as np

    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 100_000):
        counts += np.unpackbits(h[at : at + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def text_fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the XXH64 values of the shingles of a text."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row; null texts count as empty and get 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm.simhash import text_fingerprint

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = np.array([text_fingerprint(t, shingle) for t in part.column("text").to_pylist()], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of all choices of `blocks` - `radius` out of `blocks` even runs of the 64 bits, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    masks = [sum(chosen) for chosen in combinations(runs, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tree_forest(tree, fp, radius: int):
    """Spanning forest of the links (within `radius`) among rows of equal `tree`: arrays of row pairs.

    `tree` is ascending. All trees are built and searched level by level at once: the first row that reaches a place
    becomes its node, the others go on to the child at their distance; a search visits the children whose edges lie
    within the radius of its distance.
    """
    import numpy as np

    n = len(fp)
    fp = fp.view(np.uint64)
    distance = lambda a, b: np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64)
    root = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if n else np.zeros(0, np.int64)
    first = root[np.cumsum(np.isin(np.arange(n), root)) - 1]
    rest = np.setdiff1d(np.arange(n), root)
    at, parent, edge = first[rest], np.full(n, -1), np.zeros(n, np.int64)
    while len(rest):
        d = distance(rest, at)
        place = at * 65 + d
        order = np.argsort(place, kind="stable")
        rest, at, d, place = rest[order], at[order], d[order], place[order]
        new = np.concatenate([[True], place[1:] != place[:-1]])
        parent[rest[new]], edge[rest[new]] = at[new], d[new]
        node = rest[new][np.cumsum(new) - 1]
        rest, at = rest[~new], node[~new]
    child = np.flatnonzero(parent >= 0)
    key = parent[child] * 65 + edge[child]
    order = np.argsort(key, kind="stable")
    child, key = child[order], key[order]

    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, n, 1024):  # so many searches at a time
        q = np.arange(begin, min(begin + 1024, n))
        x = first[q]
        while len(q):
            d = distance(q, x)
            hit = (d <= radius) & (q != x)
            left.append(q[hit])
            right.append(x[hit])
            lo, hi = np.searchsorted(key, x * 65 + np.maximum(d - radius, 0)), np.searchsorted(key, x * 65 + np.minimum(d + radius, 64), side="right")
            many = hi - lo
            q = np.repeat(q, many)
            x = child[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(q))] if len(q) else q
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == was).all():
            break
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def tree_links(members: DataFrame, radius: int) -> DataFrame:
    """Links (fp_a, fp_b) of the trees of `members` (tree, fp): all rows of a tree meet in one task, trees follow each other."""

    @lean
    def link(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm.simhash import tree_forest

        def links(tree, fp):
            left, right = tree_forest(tree, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[left]), pa.array(fp[right])], ["fp_a", "fp_b"])

        tree, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            tree, fp = np.concatenate([tree, np.asarray(batch.column("tree"))]), np.concatenate([fp, np.asarray(batch.column("fp"))])
            whole = int(np.searchsorted(tree == tree[-1], True)) if len(tree) else 0  # the last tree may go on
            if whole:
                yield links(tree[:whole], fp[:whole])
                tree, fp = tree[whole:], fp[whole:]
        if len(tree):
            yield links(tree, fp)

    return members.repartition("tree").sortWithinPartitions("tree").select("tree", "fp").mapInArrow(link, "fp_a long, fp_b long")


def near_links(distinct: DataFrame, radius: int = 3, extra: tuple[int, ...] = (2, 5, 13), most: int = 2048) -> DataFrame:
    """Links (fp_a, fp_b) that connect the distinct fingerprints `fp` just as all pairs within `radius` bits would.

    Per level there are `radius` + `extra` blocks. Shards of more than `most` members are left to the next level: two members
    within the radius share a shard there as well. The last level takes all shards.
    """
    links, left = None, distinct.select("fp")
    for level, more in enumerate(extra):
        masks = enumerate(block_masks(radius + more, radius))
        spread = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for t, m in masks]))
        shards = written(left.select("fp", spread.alias("s")).select("fp", "s.t", "s.v"), "shards")
        sizes = shards.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
        member = shards.join(sizes, ["t", "v"])
        last = level == len(extra) - 1
        found = tree_links((member if last else member.where(F.col("n") <= most)).select("fp", F.xxhash64("t", "v").alias("tree")), radius)
        links = found if links is None else links.union(found)
        if not last:
            left = written(member.where(F.col("n") > most).select("fp").distinct(), "crowded")
            if left.isEmpty():
                break
    return links


def near_components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id (smallest doc_id reachable over links) of every row.

    Texts with equal fingerprints, the zero of empty and null texts included, are linked. Null doc_ids are never the
    smallest: a component of null doc_ids only has a null component_id. Repeated rows all come back. Other columns of
    `docs` are not read. An empty table gives no rows.
    """
    known = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(near_links(distinct, radius))
    member = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = member.groupBy("label").agg(F.min("least").alias("component_id"))
    of = member.join(least, "label").select("fp", "component_id")
    return known.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}
