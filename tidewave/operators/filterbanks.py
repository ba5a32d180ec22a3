"""Filterbanks as small matrices whose size is fixed by parameters: a row of weights per band."""

from __future__ import annotations

import math


def mel_bank(sample_rate: int, n_fft: int, n_mels: int, f_min: float = 0.0, f_max: float | None = None) -> list[list[float]]:
    """Triangles with edges evenly spaced on 2595 log10(1 + f / 700), unnormalised."""
    to_mel, to_hz = lambda f: 2595 * math.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    top = sample_rate / 2 if f_max is None else f_max
    edge = [to_hz(to_mel(f_min) + (to_mel(top) - to_mel(f_min)) * i / (n_mels + 1)) for i in range(n_mels + 2)]
    freq = [(sample_rate // 2) * k / (n_fft // 2) for k in range(n_fft // 2 + 1)]
    return [[max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for f in freq] for a, b, c in zip(edge, edge[1:], edge[2:], strict=False)]


def gammatone_bank(sample_rate: int, n_fft: int, n_bands: int, f_min: float = 50.0, f_max: float | None = None, order: int = 4) -> list[list[float]]:
    """Gammatone power responses at centres evenly spaced in ERB rate, each with area 1."""
    top = sample_rate / 2 if f_max is None else f_max
    if not 0 < f_min < top:
        raise ValueError("expected 0 < f_min < f_max")
    lo, hi = hz_to_erb(f_min), hz_to_erb(top)
    out = []
    for b in range(n_bands):
        centre = erb_to_hz(lo + (hi - lo) * b / max(1, n_bands - 1))
        width = 1.019 * 24.7 * (4.37 * centre / 1000 + 1)
        row = [(1 + ((sample_rate / 2 * k / (n_fft // 2) - centre) / width) ** 2) ** -order for k in range(n_fft // 2 + 1)]
        out.append([w / (sum(row) + 1e-12) for w in row])
    return out


def hz_to_erb(f: float) -> float:
    return 21.4 * math.log10(4.37e-3 * f + 1)


def erb_to_hz(e: float) -> float:
    return (10 ** (e / 21.4) - 1) / 4.37e-3


def chroma_bank(sample_rate: int, n_fft: int, n_chroma: int = 12, centre_octave: float = 5.0, octave_width: float = 2.0) -> list[list[float]]:
    """Weights of the bins per pitch class, from C.

    A bin lies at a number of steps (`n_chroma` to the octave) above A0; bin 0, which has no pitch, lies one and a half octaves
    below bin 1. A class weighs a bin by a Gaussian of the distance to its nearest tone, as wide as the step to the next bin
    but at least one; the weights of a bin have length 1, times a Gaussian of the bin's octave.
    """
    from_a_to_c = 3 * n_chroma // 12
    columns = []
    for k in range(n_fft // 2 + 1):
        above = n_chroma * math.log2(max(k, 1) * sample_rate / n_fft / 27.5) - (0 if k else 1.5 * n_chroma)
        width = max(1.0, n_chroma * math.log2(1 + 1 / k)) if k else 1.5 * n_chroma
        away = [math.remainder(above - from_a_to_c - tone, n_chroma) for tone in range(n_chroma)]
        near = [math.exp(-2 * (d / width) ** 2) for d in away]
        loud = math.exp(-(((above / n_chroma - centre_octave) / octave_width) ** 2) / 2) if octave_width > 0 else 1.0
        columns.append([loud * x / math.hypot(*near) for x in near])
    return [list(row) for row in zip(*columns, strict=True)]


def dct_bank(n_out: int, n_in: int) -> list[list[float]]:
    """Orthonormal DCT-II."""
    return [[math.sqrt((1 if i == 0 else 2) / n_in) * math.cos(math.pi / n_in * (j + 0.5) * i) for j in range(n_in)] for i in range(n_out)]


def tonnetz_bank() -> list[list[float]]:
    # Interval ratios and radii of the tonal centroid space (fifths, minor thirds, major thirds).
    scale, radius = [7 / 6, 7 / 6, 3 / 2, 3 / 2, 2 / 3, 2 / 3], [1.0, 1.0, 1.0, 1.0, 0.5, 0.5]
    return [[radius[r] * math.cos(math.pi * (scale[r] * c - (0.5 if r % 2 == 0 else 0.0))) for c in range(12)] for r in range(6)]
