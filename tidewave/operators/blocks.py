"""Signals of any length in blocks: recursive filters as affine maps of their state, and spectra changed and overlapped again.

No task holds a whole signal. A block of a filter is an affine map of the state it starts from; what all blocks add to the state is computed apart, a
pass over these few numbers per block gives every block its state, and outputs follow apart again. Spectra are changed in blocks of frames with a halo, and
inverse frames are added up by place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.sources.signals import checked, frames_of_points


def cascade(sections):
    """(A, B, C, D) of second-order sections (b, a) in a row: state' = A state + B x, y = C state + D x."""
    import numpy as np

    def step(state, x):
        after = np.zeros(len(state))
        for k, (b, a) in enumerate(sections):
            y = b[0] / a[0] * x + state[2 * k]
            after[2 * k], after[2 * k + 1] = (b[1] * x - a[1] * y) / a[0] + state[2 * k + 1], (b[2] * x - a[2] * y) / a[0]
            x = y
        return after, x

    size = 2 * len(sections)
    columns = [step(e, 0.0) for e in np.eye(size)]
    b, d = step(np.zeros(size), 1.0)
    return np.stack([c for c, _ in columns], axis=1), b, np.array([y for _, y in columns]), d


def block_maps(sections, length: int):
    """What a block of samples x does, from state s: output x @ response + s @ seen, state after it x @ added + carried @ s."""
    import numpy as np

    a, b, c, d = cascade(sections)
    reach, seen = [b], [c]
    for _ in range(length - 1):
        reach.append(a @ reach[-1])
        seen.append(seen[-1] @ a)
    impulse = np.concatenate([[d], np.stack(reach[:-1]) @ c]) if length > 1 else np.array([d])
    lag = np.arange(length)[None, :] - np.arange(length)[:, None]
    return np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0), np.stack(seen, axis=1), np.stack(reach[::-1]), np.linalg.matrix_power(a, length)


def _matrix(column, length: int):
    """Arrays of a batch as rows of a matrix, filled with zeros on the right, and their sizes."""
    import numpy as np

    size = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(size), length))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(column.flatten())
    return out, size


def filtered(blocks: DataFrame, sections, length: int) -> DataFrame:
    """`blocks` (signal_id, block, samples; from 0, all but the last of `length`) through second-order sections: the same columns."""

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tidewave.operators.blocks import _matrix, block_maps

        added = block_maps(sections, length)[2]
        for batch in batches:
            x, _ = _matrix(batch.column("samples"), length)
            yield pa.RecordBatch.from_arrays([batch.column("signal_id"), batch.column("block"), pa.array((x @ added).tolist(), pa.list_(pa.float64()))], ["signal_id", "block", "added"])

    def states(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.operators.blocks import block_maps

        carried = block_maps(sections, length)[3]
        signal, state = None, None
        for batch in batches:
            added = np.asarray(batch.column("added").flatten()).reshape(batch.num_rows, -1)
            out = np.zeros_like(added)
            for i, key in enumerate(batch.column("signal_id").to_pylist()):
                if i == 0 and signal is None or key != signal:
                    signal, state = key, np.zeros(added.shape[1])
                out[i] = state
                state = carried @ state + added[i]
            yield pa.RecordBatch.from_arrays([batch.column("signal_id"), batch.column("block"), pa.array(out.tolist(), pa.list_(pa.float64()))], ["signal_id", "block", "state"])

    def outputs(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.operators.blocks import _matrix, block_maps

        response, seen, _, _ = block_maps(sections, length)
        for batch in batches:
            x, size = _matrix(batch.column("samples"), length)
            y = x @ response + np.asarray(batch.column("state").flatten()).reshape(batch.num_rows, -1) @ seen
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(y[np.arange(length)[None, :] < size[:, None]]))
            yield pa.RecordBatch.from_arrays([batch.column("signal_id"), batch.column("block"), lists], ["signal_id", "block", "samples"])

    added = blocks.mapInArrow(sums, "signal_id long, block long, added array<double>")
    # Some numbers per block are all that meets by signal, and they pass in a stream.
    known = added.repartition("signal_id").sortWithinPartitions("signal_id", "block").mapInArrow(states, "signal_id long, block long, state array<double>")
    return blocks.join(known, ["signal_id", "block"]).select("signal_id", "block", "samples", "state").mapInArrow(outputs, "signal_id long, block long, samples array<double>")


def mirrored(points: DataFrame, half: int) -> DataFrame:
    """Samples with `half` reflected ones on either side (again and again in short signals); places and sizes count these."""
    last = F.col("size") - 1
    period = F.greatest(2 * last, F.lit(1))

    def images(at):
        low, high = F.ceil((F.lit(-half) - at) / period), F.floor((last + half - at) / period)
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda k: at + k * period)).otherwise(F.array().cast("array<long>"))

    inner = (F.col("i") > 0) & (F.col("i") < last)
    places = F.concat(images(F.col("i")), F.when(inner, images(-F.col("i"))).otherwise(F.array().cast("array<long>")))
    seen = points.select("signal_id", (F.col("size") + 2 * half).alias("_size"), places.alias("_places"), "x")
    return seen.select("signal_id", F.col("_size").alias("size"), F.explode("_places").alias("_i"), "x").select("signal_id", "size", (F.col("_i") + half).alias("i"), "x")


def resynthesised(points: DataFrame, n_fft: int, hop: int, change: Callable, names: list[str], halo: int = 0, per: int = 64) -> DataFrame:
    """signal_id, i and a column for each series that `change` makes of the spectra of centred frames under a periodic Hann window: inverse
    frames overlap, divided by the sum of the squared windows. Samples that no frame reaches are left out.

    `change(z, first, last)` takes the spectra (frames x bins) of a block of about `per` frames with `halo` more on either side, unless it is the
    first or last of its signal, and gives as many spectra per name.
    """
    checked(n_fft, hop)
    half = n_fft // 2
    wide = mirrored(points, half)
    sizes = points.groupBy("signal_id").agg(F.max("size").alias("size"))
    final = F.floor((F.col("size") + 2 * half - n_fft) / hop)
    rows = frames_of_points(wide, n_fft, hop, pad=False).join(sizes, "signal_id").withColumn("final", final)
    blocks = F.sequence(F.greatest(F.floor((F.col("frame_idx") - halo) / per), F.lit(0)), F.least(F.floor((F.col("frame_idx") + halo) / per), F.floor(F.col("final") / per)))
    spread = rows.select("signal_id", "final", "frame_idx", "frame", F.explode(blocks).alias("block"))
    held = spread.groupBy("signal_id", "block", "final").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "frame"))).alias("f"))
    held = held.select("signal_id", "block", "final", F.transform("f", lambda s: s["frame_idx"]).alias("t"), F.flatten(F.transform("f", lambda s: s["frame"])).alias("x"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        for batch in batches:
            for row in range(batch.num_rows):
                block, final = batch.column("block")[row].as_py(), batch.column("final")[row].as_py()
                t = np.asarray(batch.column("t")[row].values)
                x = np.asarray(batch.column("x")[row].values).reshape(len(t), n_fft)
                own = (t >= block * per) & (t < (block + 1) * per)
                made = [np.fft.irfft(z[own], n_fft, axis=1) * window for z in change(np.fft.rfft(x * window, axis=1), t[0] == 0, t[-1] == final)]
                place = (np.arange(own.sum())[:, None] * hop + np.arange(n_fft)[None, :]).ravel()
                size = int(place[-1]) + 1
                added = [np.bincount(place, m.ravel(), size) for m in (*made, np.broadcast_to(window**2, (own.sum(), n_fft)))]
                columns = [pa.array(np.full(size, batch.column("signal_id")[row].as_py(), np.int64)), pa.array(int(t[own][0]) * hop + np.arange(size))]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, added)], ["signal_id", "i", *names, "norm"])

    schema = "signal_id long, i long, " + ", ".join(f"{c} double" for c in [*names, "norm"])
    parts = held.mapInArrow(run, schema).groupBy("signal_id", "i").agg(*[F.sum(c).alias(c) for c in [*names, "norm"]])
    values = [(F.col(c) / F.when(F.col("norm") > 1e-11, F.col("norm")).otherwise(1.0)).alias(c) for c in names]
    return parts.join(sizes, "signal_id").where((F.col("i") >= half) & (F.col("i") < half + F.col("size"))).select("signal_id", (F.col("i") - half).alias("i"), *values)
