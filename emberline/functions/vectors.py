"""Numeric array expressions: similarity, level, scaling, resampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """One minus the cosine distance; null when a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def rms(samples: Column) -> Column:
    """Root mean square of an array of samples."""
    return F.when(F.size(samples) > 0, F.sqrt(dot(samples, samples) / F.size(samples)))


def pcm_to_float(samples: Column) -> Column:
    """int16 samples to floats in [-1, 1)."""
    return F.transform(samples, lambda x: x.cast("double") / 32768.0)


def float_to_pcm(samples: Column) -> Column:
    """Floats to int16 after clipping to [-1, 1]; the two half ranges scale differently.

    Halves are rounded towards positive infinity, as in browsers.
    """

    def scale(x: Column) -> Column:
        clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))
        scaled = F.when(clipped < 0, clipped * 32768.0).otherwise(clipped * 32767.0)
        return F.floor(scaled + 0.5).cast("int")

    return F.transform(samples, scale)


def wav_pcm(samples: Column) -> Column:
    """Floats to int16 for a wave file: scale by 32768, clip, cut the fraction."""
    return F.transform(
        samples,
        lambda x: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), x.cast("double") * 32768.0)).cast("int"),
    )


def downsample(samples: Column, in_rate: int, out_rate: int) -> Column:
    """Linear interpolation to a lower rate; unchanged when the rate would not fall."""
    if out_rate >= in_rate:
        return samples
    ratio = in_rate / out_rate
    length = F.floor(F.size(samples) / F.lit(ratio)).cast("int")

    def at(i: Column) -> Column:
        position = i * F.lit(ratio)
        left = F.floor(position).cast("int")
        right = F.least(left + 1, F.size(samples) - 1)
        part = position - left
        here = F.get(samples, left).cast("double")
        there = F.get(samples, right).cast("double")
        return here * (F.lit(1.0) - part) + there * part

    empty = F.array().cast("array<double>")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), at)).otherwise(empty)
