"""Exact top-k inner-product search with a bit-sliced index.

Components are quantised to integers. A block of vectors is stored as bitmaps: slice b of dimension d has bit b of
(component - least component of the block) for every row. A query adds the slices of all dimensions, weighted by the bits
of its own components, with carry-save adders on whole bitmaps; negative weights take the complemented slices, which moves
every score by the same amount. The best k rows are picked from the most significant slice of the sums downward; rows that
are still tied at the boundary after the last slice have equal scores and are resolved by id.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import file_system, fresh_dir, lean, open_input, open_output, table, written


def quantise(x, scale: float):
    """floor(scale * x) of finite doubles: 64-bit integers, or Python's where these would not hold them."""
    import numpy as np

    with np.errstate(over="ignore"):
        scaled = x * scale
    if np.abs(scaled).max(initial=0.0) < 2.0**62:
        return np.floor(scaled).astype(np.int64)
    whole = lambda v, s: math.floor(s) if math.isfinite(s) else math.floor(Fraction(v) * Fraction(scale))
    out = np.empty(x.shape, object)
    for at in np.ndindex(x.shape):
        out[at] = whole(float(x[at]), float(scaled[at]))
    return out


def build_block(ids, x) -> dict:
    """Slices of a block of integer vectors: ids (ascending), least component, least and largest of each dimension, bits, and
    words (dimensions, bits, rows / 64)."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    bits, rows = max(1, (high - low).bit_length()), -(-len(ids) // 64) * 64
    planes = np.zeros((x.shape[1], bits, rows), np.uint8)
    for b in range(bits):
        planes[:, b, : len(ids)] = (((x - low) >> b) & 1).T
    words = np.packbits(planes, axis=2, bitorder="little").view("<u8")
    least, most = (list(map(int, x.min(axis=0))), list(map(int, x.max(axis=0)))) if len(x) else ([], [])
    return {"ids": ids, "low": low, "least": least, "most": most, "bits": bits, "words": words}


def save_block(block: dict, path: str) -> None:
    """A block as one file: length of the header, header (JSON), ids, words."""
    with open_output(path) as f:
        header = json.dumps({k: block[k] for k in ("low", "least", "most", "bits")} | {"rows": len(block["ids"]), "shape": block["words"].shape}).encode()
        f.write(len(header).to_bytes(8, "little") + header)
        f.write(block["ids"].astype("<i8").tobytes())
        f.write(block["words"].tobytes())


def load_block(path: str) -> dict:
    import numpy as np

    with open_input(path) as f:
        header = json.loads(f.read(int.from_bytes(f.read(8), "little")))
        header["ids"] = np.frombuffer(f.read(8 * header["rows"]), "<i8")
        header["words"] = np.frombuffer(f.read(), "<u8").reshape(header["shape"])
    return header


def best_possible(block: dict, query) -> int:
    """No row of the block has a larger inner product with the query."""
    return sum(max(q * a, q * b) for q, a, b in zip(map(int, query), block["least"], block["most"], strict=True))


def weigh(block: dict, query) -> tuple[list, int]:
    """Slices of the scores of all rows, least significant first, and what must be added to them.

    Negative components of the query take the complemented slices.
    """
    import numpy as np

    size, bits = np.abs(query), block["bits"]
    flip = np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
    shift = block["low"] * sum(map(int, query)) - sum(map(int, size[query < 0])) * ((1 << bits) - 1)
    top, carried, out, weight = bits + int(size.max(initial=0)).bit_length(), [], [], 0
    while weight < top or carried:
        parts = carried
        for j in range(max(0, weight - bits + 1), weight + 1):
            dims = np.flatnonzero((size >> j) & 1) if j < 63 or size.dtype == object else []
            if len(dims):
                parts.append(block["words"][dims, weight - j] ^ flip[dims])
        rows = np.concatenate(parts) if parts else np.zeros((1, block["words"].shape[2]), "<u8")
        carried = []
        while len(rows) > 1:
            third = max(1, len(rows) // 3)
            if len(rows) == 2:
                a, b = rows[:1], rows[1:]
                carried.append(a & b)
                rows = a ^ b
                continue
            a, b, c, rest = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third], rows[3 * third :]
            half = a ^ b
            carried.append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rest]) if len(rest) else half ^ c
        out.append(rows[0])
        weight += 1
    return out, shift


def select_top(slices: list, allowed, k: int):
    """Row numbers of the k best allowed rows; of rows with equal sums the first ones."""
    import numpy as np

    sure, open_ = np.zeros_like(allowed), allowed
    for s in reversed(slices):
        more = sure | (open_ & s)
        n = int(np.bitwise_count(more).sum())
        if n >= k:
            open_ = open_ & s
        else:
            sure, open_ = more, open_ & ~s
    rows = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
    chosen = rows(sure)
    return np.concatenate([chosen, rows(open_)[: k - len(chosen)]])


def search_block(block: dict, query, exclude: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of a block whose id is not `exclude`."""
    import numpy as np

    n = len(block["ids"])
    allowed = np.zeros(block["words"].shape[2] * 64, np.uint8)
    allowed[:n] = 1
    allowed[np.searchsorted(block["ids"], exclude) : np.searchsorted(block["ids"], exclude, side="right")] = 0
    slices, shift = weigh(block, query)
    rows = select_top(slices, np.packbits(allowed, bitorder="little").view("<u8"), k)
    place, bit = rows >> 6, (rows & 63).astype("<u8")
    score = [shift] * len(rows)
    for w, s in enumerate(slices):
        for i in np.flatnonzero((s[place] >> bit) & np.uint64(1)).tolist():
            score[i] += 1 << w
    return list(zip(score, block["ids"][rows].tolist(), strict=True))


def finite_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows with an id and a vector of which no component is null or not finite."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(whole).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def matrix(lists, dims: int):
    """An Arrow array of lists of doubles as a matrix; shorter lists are filled with zeros."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(lists.flatten())
    return out


def build_index(rows: DataFrame, dims: int, scale: float, block_rows: int) -> str:
    """Write the sliced blocks of `rows` (id, x) as files, each from rows of one partition; returns the folder of the manifest
    (a table with the block files). A task that is run again writes under new names; the manifest names finished tasks' files."""
    spark = rows.sparkSession
    folder = fresh_dir(spark, "slices")

    @lean
    def build(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa

        def save(ids, parts):
            path = f"{folder}/blocks/{uuid.uuid4().hex}"
            save_block(build_block(np.concatenate(ids), quantise(np.concatenate(parts), scale)), path)
            return pa.RecordBatch.from_pydict({"file": [path]})

        ids, parts, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids.append(np.asarray(part.column("id")))
                parts.append(matrix(part.column("x"), dims))
                held += part.num_rows
                if held >= block_rows:
                    yield save(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield save(ids, parts)

    rows.mapInArrow(build, "file string").write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


def block_files(manifest: str) -> Iterator[str]:
    """Paths of the blocks of a manifest folder, read in tasks."""
    import pyarrow.parquet as pq

    store, inner = file_system(manifest)
    from pyarrow import fs

    for info in sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            yield from pq.read_table(info.path, filesystem=store).column("file").to_pylist()


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 32768, query_rows: int = 64) -> DataFrame:
    """The k highest integer inner products of each query over all rows but its own: query_id, rank, vec_id, score.

    Ties go to the smaller id. Vectors that are null, hold null or non-finite components or have a null id take no part;
    shorter vectors count as filled with zeros. Components and scores of any size are exact; a score that a long does not hold
    is returned as the nearest long, in its true rank. Rows that repeat an id are all candidates, except for queries of that
    id; a repeated query is answered once per distinct vector it has. Fewer than k candidates: all of them. Empty tables: no
    rows.

    The index is a table of block files. A task has some queries, opens one block after the other and keeps the k best of
    each; blocks that cannot hold a better row are passed over. Nothing but the queries is shuffled, and only answers are returned.
    """
    rows, asked = finite_vectors(vectors, id_col, vector_col), finite_vectors(queries, id_col, vector_col).distinct()
    dims = max(rows.agg(F.max(F.size("x"))).first()[0] or 0, asked.agg(F.max(F.size("x"))).first()[0] or 0)
    asked = written(asked, "questions")
    manifest = build_index(rows, dims, scale, block_rows)
    tasks = max(1, -(-asked.count() // query_rows))

    @lean
    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        files = None
        for batch in batches:
            for at in range(0, batch.num_rows, query_rows):
                part = batch.slice(at, query_rows)
                ids, asked_q = part.column("id").to_pylist(), quantise(matrix(part.column("x"), dims), scale)
                best: list[list[tuple[int, int]]] = [[] for _ in ids]
                files = files if files is not None else list(block_files(manifest))
                for file in files:
                    block = load_block(file)
                    for n, (query_id, q) in enumerate(zip(ids, asked_q, strict=True)):
                        if len(best[n]) < k or best_possible(block, q) >= best[n][-1][0]:
                            best[n] = sorted(best[n] + search_block(block, q, query_id, k), key=lambda r: (-r[0], r[1]))[:k]
                out = [(i, rank, vec, min(max(score, -(2**63)), 2**63 - 1)) for i, found in zip(ids, best, strict=True) for rank, (score, vec) in enumerate(found, 1)]
                cols = list(zip(*out, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

    return asked.repartition(tasks).mapInArrow(search, "query_id long, rank int, vec_id long, score long")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each embedding whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


QUERIES = {"op3_topk": op3_topk}
SQL = {
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
