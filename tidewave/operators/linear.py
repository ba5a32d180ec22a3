"""Linear prediction per frame: small Arrow-batched kernels for the recursions that have no relational form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _levinson(frames, order: int):
    """Coefficients a_1..a_order of A(z) = 1 + sum a_k z^-k for all rows of a matrix at once."""
    import numpy as np

    n = frames.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(frames, size, axis=1)) ** 2, size, axis=1)[:, : order + 1]
    a = np.zeros((len(frames), order + 1))
    a[:, 0] = 1.0
    error = r[:, 0] + 1e-12
    for i in range(1, order + 1):
        k = -(a[:, :i] * r[:, i:0:-1]).sum(axis=1) / error
        a[:, 1 : i + 1] = a[:, 1 : i + 1] + k[:, None] * a[:, i - 1 :: -1][:, :i]
        error = error * (1 - k * k)
    return a[:, 1:]


def lpc(frame: Column, n: int, order: int) -> Column:
    """Prediction coefficients of frames of n samples by the autocorrelation method."""
    if not 0 < order < n:
        raise ValueError("order must be positive and less than the frame length")

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(list(_levinson(np.stack(batch.to_numpy()), order))) if len(batch) else pd.Series([], dtype=object)

    return run(frame)


def lpcc(coefficients: Column, n_out: int, order: int) -> Column:
    """Cepstra by the recursion c_m = a_m + sum k/m c_k a_(m-k), coefficients beyond the order being 0. Native."""
    if n_out >= order + 2:
        raise ValueError("n_out must be less than order + 2")
    out: list[Column] = []
    for m in range(1, n_out + 1):
        term = F.get(coefficients, F.lit(m - 1)) if m <= order else F.lit(0.0)
        for k in range(1, m):
            if m - k <= order:
                term = term + (k / m) * out[k - 1] * F.get(coefficients, F.lit(m - k - 1))
        out.append(term)
    return F.array(*out)


def line_spectral_pairs(coefficients: Column, order: int) -> Column:
    """Angles of the unit-circle roots of a(z) plus and minus its reverse, ascending, filled with NaN up to the order."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        import numpy as np

        def one(a):
            full = np.concatenate([[1.0], np.asarray(a, float)])
            roots = np.concatenate([np.roots(full + full[::-1]), np.roots(full - full[::-1])])
            angle = np.unique(np.angle(roots[np.isclose(np.abs(roots), 1.0)]))[:order]
            return np.concatenate([angle, np.full(order - len(angle), np.nan)])

        return batch.map(one)

    return run(coefficients)


def formant_bandwidths(coefficients: Column, sample_rate: int) -> Column:
    """Bandwidths of the roots in the upper half plane, by angle."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        import numpy as np

        def one(a):
            roots = np.roots(np.concatenate([[1.0], np.asarray(a, float)]))
            roots = roots[roots.imag >= 0]
            with np.errstate(divide="ignore"):
                width = -sample_rate * np.log(np.abs(roots[np.argsort(np.angle(roots))])) / np.pi
            return width[np.isfinite(width)]

        return batch.map(one)

    return run(coefficients)


def formant_dispersion(formants: Column) -> Column:
    """Mean distance of neighbouring finite formants, 0 under two."""
    f = F.filter(formants, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(f) >= 2, (F.element_at(f, -1) - F.element_at(f, 1)) / (F.size(f) - 1)).otherwise(0.0)
