"""The transforms that have no relational form, as small Arrow-batched helpers over arrays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _rows(series: pd.Series, n: int):
    """The arrays of a batch as a matrix of width n: cut, or filled with zeros, on the right."""
    import numpy as np

    out = np.zeros((len(series), n))
    for i, a in enumerate(series):
        if a is not None:
            out[i, : min(n, len(a))] = a[:n]
    return out


def spectrum(n_fft: int):
    """array -> struct(re, im) of the real FFT over n_fft samples."""

    @F.pandas_udf("re array<double>, im array<double>")
    def run(a: pd.Series) -> pd.DataFrame:
        import numpy as np

        z = np.fft.rfft(_rows(a, n_fft), axis=1)
        return pd.DataFrame({"re": list(z.real), "im": list(z.imag)})

    return run


def magnitude(x: Column, n_fft: int) -> Column:
    """|rfft(x, n_fft)| as an array."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(list(np.abs(np.fft.rfft(_rows(a, n_fft), axis=1))))

    return run(x)


def whole_magnitude(x: Column) -> Column:
    """|rfft(x)| over the next power of two of each array's own length, so that no sample is cut off."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        import numpy as np

        return a.map(lambda v: np.abs(np.fft.rfft(np.asarray(v, float), 1 << max(1, (len(v) - 1).bit_length()))))

    return run(x)


def autocorrelation(x: Column, n: int) -> Column:
    """Linear autocorrelation of arrays of n samples at lags 0 to 2n - 1, by FFT."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        import numpy as np

        z = np.fft.rfft(_rows(a, n), n=2 * n, axis=1)
        return pd.Series(list(np.fft.irfft(z * np.conj(z), n=2 * n, axis=1)))

    return run(x)


def circular_autocorrelation(x: Column) -> Column:
    """irfft(|rfft(x)|^2): circular autocorrelation at an even number of lags."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        import numpy as np

        return a.map(lambda v: np.fft.irfft(np.abs(np.fft.rfft(np.asarray(v, float))) ** 2))

    return run(x)


def real_cepstrum(x: Column, n_fft: int, eps: float = 1e-12) -> Column:
    """irfft(log(|rfft(x, n_fft)| + eps))."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(list(np.fft.irfft(np.log(np.abs(np.fft.rfft(_rows(a, n_fft), axis=1)) + eps), axis=1)))

    return run(x)


def through_bank(x: Column, bank: list[list[float]], squared: bool = False) -> Column:
    """sum(w * x) per row of a bank, or sum(w * x^2): arrays as long as a row of the bank in, arrays as long as the bank out."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        import numpy as np

        rows = _rows(a, len(bank[0]))
        return pd.Series(list((rows * rows if squared else rows) @ np.array(bank).T))

    return run(x)
