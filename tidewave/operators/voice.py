"""Voice-quality measures over cycle series (array<double>), column expressions and band energies."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewave.functions.arrays import c, diff, dot, folded, let, mean, ratio, total


def relative_perturbation(series: str | Column) -> Column:
    """Mean absolute difference of neighbours over the mean: jitter of periods, shimmer of amplitudes."""
    return ratio(mean(F.transform(diff(series), F.abs)), mean(series), None)


def local_perturbation(series: str | Column) -> Column:
    """The same in percent; 0 under two cycles or for a mean of 0."""
    return F.when(F.size(c(series)) >= 2, F.coalesce(relative_perturbation(series) * 100, F.lit(0.0))).otherwise(0.0)


def smoothed_perturbation(series: str | Column, width: int) -> Column:
    """Mean distance from the centred moving average of `width` cycles, over the mean, in percent (PPQ5, APQ3)."""
    half = width // 2

    def of(x: Column) -> Column:
        n = F.size(x)
        centre = F.sequence(F.lit(half), F.greatest(n - 1 - half, F.lit(half)))
        away = F.transform(centre, lambda i: F.abs(F.get(x, i) - total(F.slice(x, i - half + 1, width)) / width))
        return F.when(n >= width, F.coalesce(ratio(mean(away), mean(x), None) * 100, F.lit(0.0))).otherwise(0.0)

    return let(series, of)


def second_difference_perturbation(series: str | Column) -> Column:
    """Mean absolute second difference over the mean, in percent (DDP, DDA); 0 under three cycles."""
    return F.when(F.size(c(series)) >= 3, F.coalesce(ratio(mean(F.transform(diff(diff(series)), F.abs)), mean(series), None) * 100, F.lit(0.0))).otherwise(0.0)


def shimmer_local_db(amplitudes: str | Column) -> Column:
    steps = diff(amplitudes, lambda a, b: F.abs(20 * F.log10((a + 1e-9) / (b + 1e-9))))
    return F.when(F.size(c(amplitudes)) >= 2, mean(steps)).otherwise(0.0)


def vocal_fry_index(f0: str | Column) -> Column:
    """Share of voiced steps whose pitch is under 70 Hz and whose period changes by over a fifth."""
    x = c(f0)
    voiced = F.filter(x, lambda v: v > 0)
    # The change times the pitch, as the twin has it: divided by the period, changes of a fifth to the dot round to the other side.
    jump = diff(voiced, lambda now, before: F.when((before < 70) & (F.abs(F.lit(1.0) / now - F.lit(1.0) / before) * before > 0.2), 1.0).otherwise(0.0))
    return F.when(F.size(voiced) >= 2, total(jump) / (F.size(voiced) - 1 + F.lit(1e-8))).otherwise(0.0)


def maximum_flow_declination_rate(flow: str | Column, sample_rate: int) -> Column:
    return F.array_max(diff(flow, lambda a, b: (b - a) * sample_rate))


def harmonic_to_noise_ratio(harmonic: str | Column, noise: str | Column) -> Column:
    return 10 * F.log10(c(harmonic) / (c(noise) + 1e-8))


def soft_phonation_index(low: str | Column, high: str | Column) -> Column:
    """High over low band energy in dB."""
    return 10 * F.log10(c(high) / (c(low) + 1e-8))


def normalized_amplitude_quotient(peak_flow: str | Column, declination: str | Column, period: str | Column) -> Column:
    return c(peak_flow) / (c(declination) * c(period))


def closed_quotient(open_time: str | Column, close_time: str | Column, period: str | Column) -> Column:
    return (c(close_time) - c(open_time)) / c(period)


def glottal_closure_time(open_times: str | Column, close_times: str | Column, periods: str | Column) -> Column:
    """Mean closed quotient of the cycles."""
    return mean(F.zip_with(F.zip_with(c(close_times), c(open_times), lambda a, b: a - b), c(periods), lambda d, p: d / p))


def speed_quotient(open_times: str | Column, close_times: str | Column) -> Column:
    return mean(open_times) / (mean(close_times) + 1e-8)


def vocal_tract_length(f1: str | Column, f2: str | Column, speed: float = 34400.0) -> Column:
    return F.lit(speed / 4) * (1 / c(f1) + 1 / (c(f2) - c(f1)))


def subharmonic_to_harmonic_ratio(magnitudes: str | Column, f0_bin: int | Column, harmonics: int) -> Column:
    """Power in dB halfway between the harmonics over that at the harmonics; `f0_bin` is the bin of the fundamental."""
    m = c(magnitudes)
    f0_bin = F.lit(f0_bin) if isinstance(f0_bin, int) else f0_bin
    at = lambda shift: total(F.transform(F.sequence(F.lit(1), F.lit(harmonics)), lambda k: F.pow(F.get(m, k * f0_bin + shift), F.lit(2.0))))
    return 10 * F.log10(at(F.floor(f0_bin / 2).cast("int")) / (at(F.lit(0)) + 1e-8))


def harmonic_differences(magnitudes: str | Column, f0_hz: float, sample_rate: int, n_magnitudes: int | Column, harmonics: tuple[int, ...] = (1, 2)) -> Column:
    """Differences in dB of neighbouring harmonics; the number of magnitudes counts as the transform size, missing bins as 1e-8."""
    step = F.floor(F.lit(float(f0_hz)) / (F.lit(float(sample_rate)) / n_magnitudes)).cast("int")
    level = [20 * F.log10(F.coalesce(F.get(c(magnitudes), h * step), F.lit(1e-8)) + 1e-8) for h in harmonics]
    return F.array(*[a - b for a, b in zip(level[:-1], level[1:], strict=True)])


def semitone_sd(f0: str | Column) -> Column:
    """Sample deviation of semitones about the mean pitch of voiced frames; 0 without any, null for one."""
    v = F.filter(c(f0), lambda x: x > 0)
    tones = F.transform(v, lambda x: 12 * F.log2(x))  # the deviation does not depend on what they are counted from
    spread = F.sqrt(folded(tones, mean(tones), lambda t, m: (t - m) * (t - m)) / (F.size(v) - 1))
    return F.when(F.size(v) == 0, 0.0).when(F.size(v) > 1, spread)


def delta_series(x: str | Column) -> Column:
    """0, then differences of neighbours."""
    return F.concat(F.array(F.lit(0.0)), diff(x))


def glottal_to_noise_excitation(spectrum: str | Column, n: int, bands: int = 6) -> Column:
    """Largest product g of two of the even bands of an array of `n` values, a band with itself included: 10 log10(g / (1 - g + 1e-8)), null where that
    is undefined (g over 1)."""
    if n % bands:
        raise ValueError(f"the number of values must be a multiple of {bands}")
    part = lambda x, b: F.slice(x, 1 + b * (n // bands), n // bands)
    largest = lambda x: F.greatest(*[dot(part(x, a), part(x, b)) for a in range(bands) for b in range(a, bands)])
    return let(let(spectrum, largest), lambda g: F.when(g / (1 - g + 1e-8) > 0, 10 * F.log10(g / (1 - g + 1e-8))))
