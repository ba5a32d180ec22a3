"""Product codes of vectors by k-means with norm-of-sum bounds.

Vectors of integers are cut into equal parts, and every part position has its own codebook. A part keeps the entry it is
assigned to, a bound from above of its distance to that entry and a bound from below of its distance to every other one, each stamped with the
round whose codebook it was measured against. All codebooks are retained, so a bound of round r is moved to the present round by the
net displacement of its entry since r, the length of the sum of its moves; this is never more than the sum of their lengths. An entry whose
moved bound from below exceeds the bound from above cannot be the nearest, nor tie with it; only entries left over are measured anew,
in whole numbers.

Vectors and bounds are one written table per round. A task writes its vectors and, at its end, the sums and counts of its entries, so a
round reads the vectors once; what comes to the driver is one row per part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import discard, free_names, lean, table, written

#: Components below this are computed as 64-bit integers, larger ones as Python integers.
SAFE = 1 << 24
LONG = (1 << 63) - 1
#: Bounds give way by this share, far more than rounding takes.
SLACK = 1e-6


def whole_components(x, scale: int):
    """floor(scale * x) of an array of finite doubles, exactly, as 64-bit or, where large, Python integers."""
    import numpy as np

    y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < SAFE:
        return y.astype(np.int64)
    return np.frompyfunc(lambda v: int(v) if abs(v) < 2**1000 else int(v / scale) * scale, 1, 1)(np.where(np.isfinite(y), y, x))


def part_ends(dims: int, parts: int) -> list[int]:
    """Where the parts of a vector end, from 0 on; equal if `parts` divides `dims`."""
    return [dims * i // parts for i in range(parts + 1)]


def squared(x, entry):
    """Exact squared distances of rows to one entry each, or to one entry."""
    d = x - entry
    return (d * d).sum(axis=1)


def roots(values):
    import numpy as np

    return np.minimum(np.sqrt(values.astype(np.float64)), 3e38)


def displacements(history: list, part: int):
    """Array [round, entry]: how far an entry of the last codebook lies from where it was in each round, a little enlarged."""
    import numpy as np

    now = history[-1][part]
    return np.stack([roots(((now - was[part]) ** 2).sum(axis=1)) for was in history]) * (1 + SLACK)


def assign(x, state, history: list, part: int):
    """Nearest entries of the parts x, from the bounds `state` = (code, upper, its round, lower [row, entry], their rounds); all are brought up to
    date in place. Returns how many distances were measured."""
    import numpy as np

    code, upper, upper_round, lower, lower_round = state
    book, now, rows = history[-1][part], len(history) - 1, np.arange(len(x))
    moved = displacements(history, part)
    above = upper + moved[upper_round, code]
    below = lower - moved[lower_round, np.arange(len(book))]
    doubt = below <= above[:, None] * (1 + SLACK)
    doubt[rows, code] = False
    look = np.flatnonzero(doubt.any(axis=1))
    best = squared(x[look], book[code[look]])  # the bound from above becomes the distance itself
    upper[look], upper_round[look] = np.nextafter((roots(best) * (1 + SLACK)).astype(np.float32), np.float32(np.inf)), now
    measured = len(look)
    old = code[look].copy()
    lower[look, old], lower_round[look, old] = roots(best) * (1 - SLACK), now
    open_ = below[look] <= upper[look].astype(np.float64)[:, None] * (1 + SLACK)
    open_[np.arange(len(look)), old] = False
    for j in range(len(book)):
        at = np.flatnonzero(open_[:, j])
        if not len(at):
            continue
        r = look[at]
        d = squared(x[r], book[j])
        measured += len(at)
        lower[r, j], lower_round[r, j] = roots(d) * (1 - SLACK), now
        better = (d < best[at]) | ((d == best[at]) & (j < code[r]))
        code[r[better]], best[at[better]] = j, d[better]
    changed = look[code[look] != old]
    upper[changed] = np.nextafter((lower[changed, code[changed]] / (1 - SLACK) * (1 + 2 * SLACK)).astype(np.float32), np.float32(np.inf))
    return measured


def _state_size(entries: int, parts: int) -> int:
    return parts * (1 + 4 + 1 + 5 * entries)


def unpack_state(data: bytes, n: int, entries: int, parts: int) -> list[tuple]:
    """Bounds of n rows, part by part, as arrays that may be changed."""
    import numpy as np

    raw = np.frombuffer(data, np.uint8).reshape(n, parts, -1)
    cut = lambda a, b, kind: np.ascontiguousarray(raw[:, p, a:b]).view(kind)
    out = []
    for p in range(parts):
        code, stamp = raw[:, p, 0].astype(np.int64), raw[:, p, 5].astype(np.int64)
        out.append((code, cut(1, 5, np.float32)[:, 0].astype(np.float64).astype(np.float32), stamp, cut(6, 6 + 4 * entries, np.float32).copy(), raw[:, p, 6 + 4 * entries :].astype(np.int64)))
    return out


def pack_state(states: list[tuple]):
    """One row of bytes per vector."""
    import numpy as np

    parts = []
    for code, upper, stamp, lower, lower_round in states:
        n = len(code)
        bytes_of = lambda a, kind: np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(n, -1)  # noqa: B023, E731
        parts.append(np.concatenate([bytes_of(code, np.uint8), bytes_of(upper, np.float32), bytes_of(stamp, np.uint8), bytes_of(lower, np.float32), bytes_of(lower_round, np.uint8)], axis=1))
    return np.concatenate(parts, axis=1)


def _round(rows: DataFrame, history: list, scale: int, ends: list[int], last: bool) -> DataFrame:
    """Rows with codes and bounds for the last codebook of the history; also rows of sums (kind 1) unless it is the last round, which
    gives error, the summed squared distances."""
    parts, entries, start = len(ends) - 1, len(history[-1][0]), len(history) == 1
    shared = rows.sparkSession.sparkContext.broadcast(history)

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm.codes import LONG, assign, pack_state, squared, unpack_state, whole_components

        books = shared.value
        counts = np.zeros((parts, entries), np.int64)
        sums = [np.zeros((entries, b - a), object) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        names = ["vec_id", "label", "x", "state", "error", "kind", "part", "entry", "count", "sums"]
        text = pa.list_(pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                x = whole_components(np.asarray(batch.column("x").flatten(), np.float64).reshape(n, -1), scale)
                if start:
                    states = [(np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.zeros(n, np.int64), np.zeros((n, entries), np.float32), np.zeros((n, entries), np.int64)) for _ in range(parts)]
                else:
                    states = unpack_state(b"".join(batch.column("state").to_pylist()), n, entries, parts)
                error = [0] * n if x.dtype == object else np.zeros(n, np.int64)
                for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    own = x[:, a:b]
                    assign(own, states[p], books, p)
                    code = states[p][0]
                    if last:
                        error = error + squared(own, books[-1][p][code])
                    else:
                        counts[p] += np.bincount(code, minlength=entries)
                        for e in np.unique(code):
                            sums[p][e] += own[code == e].sum(axis=0).astype(object)
                error = pa.array([min(int(e), LONG) for e in error], pa.int64()) if last else pa.nulls(n, pa.int64())
                state = pa.array([r.tobytes() for r in pack_state(states)], pa.binary())
                none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, text)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), state, error, pa.array(np.zeros(n, np.int32)), *none], names)
        seen = np.argwhere(counts > 0).tolist()
        if seen:
            n = len(seen)
            own = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(np.ones(n, np.int32))]
            of = [pa.array([p for p, _ in seen], pa.int32()), pa.array([e for _, e in seen], pa.int32()), pa.array([int(counts[p, e]) for p, e in seen], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *of, pa.array([[str(int(v)) for v in sums[p][e]] for p, e in seen], text)], names)

    schema = "vec_id long, label string, x array<double>, state binary, error long, kind int, part int, entry int, count long, sums array<string>"
    return rows.mapInArrow(run, schema)


def kept_vectors(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """vec_id, label (as text), x of the rows whose vector is whole: neither null nor with null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    return vectors.where(sound & (F.size(vector) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), x.alias("x"))


def train_codes(vectors: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list]:
    """vec_id, label, code (two hexadecimal digits a part), error (summed squared distances) of every whole vector, and the history of codebooks
    (round, part, entry, position).

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do those whose length is not that of the vector
    of smallest vec_id. Entries start as the vectors of smallest vec_id (null ids last; ties by the vector), fewer if there are fewer
    vectors. Repeated rows count each. Errors of over 2^63 - 1 are given as that. An empty table gives no rows.
    """
    kept = kept_vectors(vectors, vector, label)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    dims = len(first[0].x) if first else 0
    kept = kept.where(F.size("x") == dims)
    seeds = [r.x for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    if not seeds:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    import numpy as np

    ends = part_ends(dims, parts)
    start = whole_components(np.array(seeds, np.float64), scale)
    history = [[start[:, a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]]
    rows, before = kept, None
    for k in range(rounds + 1):
        made = written(_round(rows, history, scale, ends, k == rounds), "codes")
        rows = made.where("kind = 0").select("vec_id", "label", "x", "state", "error")
        if before is not None:
            discard(before)
        before = made
        if k == rounds:
            break
        sums = made.where("kind = 1").select("part", "entry", "count", F.posexplode("sums").alias("at", "v"))
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("count").alias("count"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        after = [book.copy() for book in history[-1]]
        for r in sums.collect():
            value = int(r.v) // r["count"]
            if after[r.part].dtype != object and abs(value) >= SAFE:
                after[r.part] = after[r.part].astype(object)
            after[r.part][r.entry, r.at] = value
        history.append(after)
    width = _state_size(len(seeds), parts) // parts
    digits = [F.hex(F.substring("state", 1 + p * width, 1)) for p in range(parts)]
    return rows.select("vec_id", "label", F.lower(F.concat(*digits)).alias("code"), "error"), history


def codebooks_digest(history: list) -> str:
    """SHA-256 of the last codebooks' integers in order of part, entry and position, joined by commas."""
    values = [str(int(v)) for book in (history[-1] if history else []) for entry in book for v in entry]
    return hashlib.sha256(",".join(values).encode()).hexdigest()


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector, and the digest of the codebooks."""
    codes, history = train_codes(table(spark, sf_dir, "embeddings"))
    (label,) = free_names(codes, "label_")
    sums = codes.groupBy(F.col("label").alias(label)).agg(F.sum("error").alias("label_error"))
    out = codes.join(sums, codes["label"].eqNullSafe(sums[label]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(history)).alias("codebooks_sha256"))


QUERIES = {"op11_codes": op11_codes}


def _sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same with plain nearest-entry searches, round by round."""
    out = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"pieces AS MATERIALIZED (SELECT vec_id, p, list_slice(x, 1 + (p * len(x)) // {parts}, ((p + 1) * len(x)) // {parts}) AS x FROM kept, range({parts}) AS r(p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries})",
        "book0 AS MATERIALIZED (SELECT p, e, x AS c FROM pieces JOIN first USING (vec_id))",
    ]
    distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    for k in range(rounds + 1):
        out.append(f"near{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := {distance}, e := e)) AS m FROM pieces JOIN book{k} USING (p) GROUP BY vec_id, p)")
        if k < rounds:
            out.append(f"sums{k} AS (SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, m.e AS e, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{k}) GROUP BY p, e, i)")
            out.append(f"mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{k} GROUP BY p, e)")
            out.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, o.c) AS c FROM book{k} o LEFT JOIN mean{k} n USING (p, e))")
    out.append(f"coded AS (SELECT vec_id, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)")
    out.append(f"digest AS (SELECT sha256(string_agg(v, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(c, ',') AS v FROM book{rounds}))")
    out.append("labelled AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (vec_id))")
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM labelled, digest"


SQL = {"op11_codes": _sql()}
