"""Vector expressions built from Spark SQL functions; elements are widened to double before any arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null if the lengths differ (zip_with pads with null)."""
    return total(F.transform(minus(a, b), lambda d: d * d))


def sq_norm(v: Column) -> Column:
    return total(F.transform(v, lambda x: x * x))


def l1_norm(v: Column) -> Column:
    return total(F.transform(v, lambda x: F.abs(x)))


def sign_words(v: Column) -> Column:
    """Bit i % 32 of word i // 32 tells whether element i is 0 or more."""
    def word(w: Column) -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.when(F.get(v, w * 32 + j) >= 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), j).cast("long"))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 32).cast("int")), word)


def code_hex(v: Column) -> Column:
    """The sign code's bytes in hex: bit i % 8 of byte i // 8."""
    def byte(b: Column) -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(F.get(v, b * 8 + j) >= 0, F.pow(F.lit(2.0), j).cast("int")).otherwise(0))
        return F.lpad(F.hex(F.aggregate(bits, F.lit(0), lambda s, x: s + x)), 2, "0")

    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.floor((F.size(v) + 7) / 8).cast("int") - 1), byte))


def sign_dot(q: Column, o: Column) -> Column:
    """The centred query's elements, added where the stored sign is positive, subtracted elsewhere."""
    return total(F.zip_with(q, o, lambda x, y: F.when(y >= 0, x).otherwise(-x)))


def asym(qsq: Column, sq: Column, l1: Column, dot: Column) -> Column:
    return F.when(l1 == 0, sq).otherwise(qsq + sq - 2 * sq * dot / l1)


def paper(qsq: Column, sq: Column, l1: Column, dot: Column, dim: Column) -> Column:
    correction = l1 / (F.sqrt(dim.cast("double")) * F.sqrt(sq))
    return F.when((sq == 0) | (l1 == 0), qsq + sq).otherwise(qsq + sq - 2 * F.sqrt(sq * qsq) * dot * correction / l1)


def sym(qsq: Column, sq: Column, a: Column, b: Column, dim: Column) -> Column:
    """From codes alone; padding bits agree, and count."""
    return sym_of(qsq, sq, F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x), dim)


def sym_of(qsq: Column, sq: Column, differ: Column, dim: Column) -> Column:
    """sym(), from how many signs differ."""
    bits = F.ceil(dim / 8) * 8
    return qsq + sq - 2 * F.sqrt(qsq * sq) * (2 * (bits - differ) / bits - 1)


def register(spark: SparkSession) -> None:
    """l2sq(a, b) and rabitq_asym(qsq, sq, l1, dot) as SQL functions of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2sq(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, v) -> s + v)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rabitq_asym(qsq DOUBLE, sq DOUBLE, l1 DOUBLE, dot DOUBLE) RETURNS DOUBLE RETURN CASE WHEN l1 = 0 THEN sq ELSE qsq + sq - 2 * sq * dot / l1 END")
