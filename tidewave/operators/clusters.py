"""k-means of the frames of every signal at once, and speaker labels from cepstra.

An iteration is one aggregation: frames meet their signal's centroids, and sums per signal, cluster and dimension are made
before the shuffle, so a signal with very many frames is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.arrays import total
from tidewave.operators.spectrograms import mfcc_frames
from tidewave.storage import discard, written


def _nearest(vector: Column, centroids: Column) -> Column:
    """Number of the centroid at the least distance, the first on ties (distances are compared to 9 places)."""
    away = F.transform(centroids, lambda m: F.round(total(F.zip_with(vector, m, lambda a, b: (a - b) * (a - b))), 9))
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def kmeans(points: DataFrame, n_clusters: int, max_iters: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """Lloyd's algorithm per signal: signal_id, frame_idx, label of every row of `points` (signal_id, frame_idx, v array).

    The first centroids are the vectors at evenly spaced places of the signal's order of frames; a cluster without frames
    starts again from its own. A signal stops when its centroids move no more than by `tolerance`; the loop ends when all
    have, or after `max_iters`. Signals with fewer frames than clusters have repeated centroids, of which the first wins.
    Null vectors have no label and no row.
    """
    if n_clusters < 1 or max_iters < 1:
        raise ValueError("n_clusters and max_iters must be positive")
    points = written(points.where("v is not null").select("signal_id", "frame_idx", "v"), "points")
    ranked = points.withColumn("i", F.row_number().over(Window.partitionBy("signal_id").orderBy("frame_idx")) - 1)
    counted = ranked.join(points.groupBy("signal_id").agg(F.count("*").alias("n")), "signal_id")
    places = F.transform(F.sequence(F.lit(0), F.lit(n_clusters - 1)), lambda c: F.struct(F.floor(c * F.col("n") / n_clusters).alias("place"), c.alias("c")))
    chosen = counted.withColumn("p", F.explode(places)).where("p.place = i")
    first = chosen.groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p.c", "v"))), lambda s: s["v"]).alias("m"))
    seeds = written(first, "seeds")
    before, centroids = seeds, seeds.withColumn("seed", F.col("m"))
    for _ in range(max_iters):
        labelled = points.join(centroids, "signal_id").select("signal_id", _nearest(F.col("v"), F.col("m")).alias("c"), F.posexplode("v").alias("d", "x"))
        means = labelled.groupBy("signal_id", "c", "d").agg(F.avg("x").alias("x"))
        vectors = means.groupBy("signal_id", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
        found = vectors.groupBy("signal_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("by"))
        moved = centroids.join(found, "signal_id").withColumn("new", F.transform("seed", lambda s, i: F.coalesce(F.try_element_at(F.col("by"), i), s)))
        far = F.exists(F.zip_with("m", "new", lambda a, b: F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > tolerance), lambda t: t)), lambda t: t)
        after = written(moved.select("signal_id", F.col("new").alias("m"), "seed", far.alias("moving")), "centroids")
        discard(before)
        before, centroids = after, after.drop("moving")
        if not after.where("moving").limit(1).count():
            break
    return points.join(centroids, "signal_id").select("signal_id", "frame_idx", _nearest(F.col("v"), F.col("m")).alias("label"))


def speaker_labels(signals: DataFrame, sample_rate: int, n_speakers: int, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, n_mfcc: int = 13, max_iters: int = 100) -> DataFrame:
    """Cluster of every cepstral frame: signal_id, frame_idx, label. Signals shorter than a frame have none."""
    cepstra = mfcc_frames(signals, sample_rate, n_mfcc, n_fft, hop, n_mels)
    return kmeans(cepstra.withColumnRenamed("mfcc", "v"), n_speakers, max_iters)
