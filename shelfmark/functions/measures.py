"""Numbers measured on contents: perceptual bits, recompression, print sizes, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Printed sizes in millimetres.
PRINT_FORMATS = {"A4": (210, 297), "A5": (148, 210), "10x15": (100, 150)}
PRINT_DPI = 300
FLAT_STRUCTURE = 0.5


def perceptual_bits(coefficients: Column) -> Column:
    """63 bits as a long: bit i is set where coefficient i exceeds the 32nd smallest of the 63."""
    c = F.slice(coefficients, 1, 63)
    median = F.element_at(F.sort_array(c), 32)
    bits = F.transform(c, lambda x, i: F.when(x > median, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)


def structure(coefficients: Column) -> Column:
    """Mean distance of the coefficients from their median, by 256; below 0.5 a picture is flat and has no fingerprint."""
    c = F.slice(coefficients, 1, 63)
    median = F.element_at(F.sort_array(c), 32)
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + F.abs(x - median)) / 63 / 256


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def aspect_log_ratio(a: Column, b: Column) -> Column:
    """0 where an aspect is unknown."""
    return F.when((a > 0) & (b > 0), F.abs(F.ln(a / b))).otherwise(0.0)


def jpeg_quality(luma_sum: Column) -> Column:
    """Quality 1 to 100 from the sum of the luma quantisation table."""
    scale = 100.0 * luma_sum / 3688
    q = F.when(scale > 100, 5000 / scale).otherwise((200 - scale) / 2)
    return F.bround(F.greatest(F.lit(1.0), F.least(F.lit(100.0), q)), 0).cast("int")


def recompression(luma_sum: Column, lossless: Column, bits_per_pixel: Column) -> Column:
    """struct(score 0..1, basis): by the quantisation table, else none for lossless, else by bits for a pixel."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    by_table = clamp((92 - jpeg_quality(luma_sum)) / 42)
    by_bits = F.when(bits_per_pixel > 0, clamp((1 - F.log2(bits_per_pixel)) / 3))
    score = F.when(luma_sum > 0, by_table).when(lossless, 0.0).otherwise(by_bits)
    basis = F.when(luma_sum > 0, "jpeg_tables").when(lossless, "lossless").when(by_bits.isNotNull(), "bits_per_pixel")
    return F.struct(score.alias("score"), basis.alias("basis"))


def laplacian_variance(rows: Column) -> Column:
    """Sharpness of a small grey picture given as rows: the variance of its 3x3 Laplacian inside the border."""
    inner = F.sequence(F.lit(1), F.size(rows) - 2)
    at = lambda y, x: F.get(F.get(rows, y), x)
    values = F.flatten(
        F.transform(
            inner,
            lambda y: F.transform(F.sequence(F.lit(1), F.size(F.get(rows, y)) - 2), lambda x: at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4.0 * at(y, x)),
        )
    )
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n


def megapixels(width: Column, height: Column) -> Column:
    return F.bround(width.cast("double") * height / 1e6, 2)


def print_need(fmt: str) -> float:
    """Megapixels that a print needs."""
    a, b = (round(x / 25.4 * PRINT_DPI) for x in PRINT_FORMATS[fmt])
    return round(a * b / 1e6, 2)


def print_fitness(mp: Column) -> Column:
    """The largest size that the pixels reach, or null."""
    out = None
    for name in ("A4", "A5", "10x15"):
        hit = mp >= print_need(name)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / n)
