"""Recurrences along the frames of a signal, in blocks: every block runs at once from a guess of the state it starts from.

A block whose predecessor ends in another state than it started from runs again, until none does. Recurrences that forget where they came from (tracking,
likeliest paths) agree after a round or two; others take a round per block at most, and the result is always that of one run from end to end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.storage import discard, written


def blocks_of_frames(rows: DataFrame, per: int, *columns: str) -> DataFrame:
    """signal_id, block, frames (array of structs in order of frame_idx): runs of `per` frames, numbered from 0 without gaps."""
    frames = F.array_sort(F.collect_list(F.struct("frame_idx", *columns)))
    return rows.groupBy("signal_id", F.floor(F.col("frame_idx") / per).alias("block")).agg(frames.alias("frames"))


def settle(blocks: DataFrame, run: Callable, same: Callable) -> DataFrame:
    """`blocks` (signal_id, block, frames; written) with entry: the state (array of doubles) each starts from, null for the first of a signal.

    `run(frames, entry)` gives the state after a block; entry is None for the first block and, as the guess, `run(None, None)` for others. `same(a, b)`
    tells whether a run from a is as good as one from b.
    """

    def go(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                entry = batch.column("entry")[at]
                entry = np.asarray(entry.values) if entry.is_valid else run(None, None) if batch.column("block")[at].as_py() else None
                state = run(batch.column("frames")[at].as_py(), entry)
                kept = [pa.array([None if entry is None else entry.tolist()], pa.list_(pa.float64())), pa.array([state.tolist()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("signal_id").slice(at, 1), batch.column("block").slice(at, 1), *kept], ["signal_id", "block", "entry", "state"])

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            pairs = zip(batch.column("entry"), batch.column("given"), strict=True)
            yield batch.select(["signal_id", "block", "given"]).filter(pa.array([not same(np.asarray(a.values), np.asarray(b.values)) for a, b in pairs], pa.bool_()))

    kinds = "signal_id long, block long, entry array<double>, state array<double>"
    guess = blocks.withColumn("entry", F.lit(None).cast("array<double>"))
    known = written(guess.select("signal_id", "block", "frames", "entry").mapInArrow(go, kinds), "chain")
    while True:
        before = known.select("signal_id", (F.col("block") + 1).alias("block"), F.col("state").alias("given"))
        met = known.where("entry is not null").select("signal_id", "block", "entry").join(before, ["signal_id", "block"])
        stale = written(met.mapInArrow(compare, "signal_id long, block long, given array<double>"), "stale")
        if stale.isEmpty():
            discard(stale)
            out = blocks.join(known.select("signal_id", "block", "entry"), ["signal_id", "block"])
            return out
        again = blocks.join(stale.withColumnRenamed("given", "entry"), ["signal_id", "block"]).select("signal_id", "block", "frames", "entry").mapInArrow(go, kinds)
        after = written(known.join(stale, ["signal_id", "block"], "left_anti").union(again), "chain")
        discard(known, stale)
        known = after


def tracked(seen: DataFrame, search, columns: list[str], outputs: list[str], per: int = 512) -> DataFrame:
    """signal_id, frame_idx and the outputs on the likeliest path through the candidates (`columns`, arrays) of the frames of every signal.

    Blocks of `per` frames are searched apart from scores that `settle` brings to agreement (`search.run`, `search.same`). Each then says which state
    before it every state after it came from, or -1 for none (`search.origins`); one pass over these maps, last block first, gives the states at the cuts, and
    the blocks are decoded apart (`search.path`). A signal of fewer than `per` frames is one block, which starts from nothing and ends in its best state: it
    is searched once, by `search.path` without a last state.
    """
    blocks = written(blocks_of_frames(seen, per, *columns), "frames")
    alone = (F.col("block") == 0) & (F.size("frames") < per)
    state = lambda entry: entry.values.to_numpy() if entry.is_valid else None

    def origins(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                origin, best = search.origins(batch.column("frames")[at].as_py(), state(batch.column("entry")[at]))
                yield pa.RecordBatch.from_arrays([batch.column("signal_id").slice(at, 1), batch.column("block").slice(at, 1), pa.array([origin.tolist()], pa.list_(pa.int32())), pa.array([best], pa.int32())], ["signal_id", "block", "origin", "best"])

    def cuts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        signal, last = None, None
        for batch in batches:
            out = []
            for key, origin, best in zip(batch.column("signal_id").to_pylist(), batch.column("origin"), batch.column("best").to_pylist(), strict=True):
                last = last if last is not None and key == signal else best
                signal = key
                out.append(last)
                last = origin.values[last].as_py() if last >= 0 else -1
            yield pa.RecordBatch.from_arrays([batch.column("signal_id"), batch.column("block"), pa.array(out, pa.int32())], ["signal_id", "block", "last"])

    def decode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows_of(made):
            ids = [pa.array(np.repeat([m[0] for m in made], [len(m[1]) for m in made]), pa.int64()), pa.array(np.concatenate([m[1] for m in made]), pa.int64())]
            return pa.RecordBatch.from_arrays([*ids, *(pa.array(np.concatenate(v), pa.float64()) for v in zip(*(m[2] for m in made), strict=True))], ["signal_id", "frame_idx", *outputs])

        for batch in batches:
            made, held = [], 0
            for at in range(batch.num_rows):
                frames = batch.column("frames")[at].as_py()
                found = search.path(frames, state(batch.column("entry")[at]), batch.column("last")[at].as_py())
                made.append((batch.column("signal_id")[at].as_py(), [f["frame_idx"] for f in frames], found))
                held += len(frames)
                if held > 1 << 16:
                    yield rows_of(made)
                    made, held = [], 0
            if made:
                yield rows_of(made)

    schema = "signal_id long, frame_idx long, " + ", ".join(f"{c} double" for c in outputs)
    whole = blocks.where(alone).select("signal_id", "block", "frames", F.lit(None).cast("array<double>").alias("entry"), F.lit(None).cast("int").alias("last")).mapInArrow(decode, schema)
    rest = blocks.where(~alone)
    if rest.isEmpty():
        return whole
    known = written(settle(rest, search.run, search.same), "entries")
    maps = known.mapInArrow(origins, "signal_id long, block long, origin array<int>, best int")
    ends = maps.repartition("signal_id").sortWithinPartitions("signal_id", F.desc("block")).mapInArrow(cuts, "signal_id long, block long, last int")
    return whole.union(known.join(ends, ["signal_id", "block"]).select("signal_id", "block", "frames", "entry", "last").mapInArrow(decode, schema))
