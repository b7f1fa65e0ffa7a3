"""Pitch and zero-point arithmetic of integer and floating-point fake quantisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE_FLOOR = 1e-5
PITCH_FLOOR = 1e-9


@dataclass(frozen=True)
class IntFormat:
    """An integer grid: bit width, symmetric or not, zero point rounded or not."""

    bits: int
    symmetric: bool = False
    round_zero: bool = True

    @property
    def low(self) -> float:
        return float(-(2 ** (self.bits - 1))) if self.symmetric else 0.0

    @property
    def high(self) -> float:
        return float(2 ** (self.bits - 1) - 1) if self.symmetric else float(2**self.bits - 1)

    @property
    def storage(self) -> str:
        """Smallest Spark type that holds the codes."""
        if self.bits <= 8:
            return "tinyint" if self.symmetric else "smallint"
        return "int"

    def pitch(self, low: Column, high: Column) -> Column:
        if self.symmetric:
            reach = F.greatest(F.abs(high), F.abs(low), F.lit(RANGE_FLOOR))
            return reach / F.lit(self.high)
        return F.greatest(high - low, F.lit(RANGE_FLOOR)) / F.lit(self.high - self.low)

    def zero(self, low: Column, pitch: Column) -> Column:
        if self.symmetric:
            return F.lit(0.0)
        if not self.round_zero:
            return F.lit(self.low) - low / pitch
        return clamp(F.lit(self.low) - F.rint(low / pitch), self.low, self.high)

    def code(self, value: Column, pitch: Column, zero: Column) -> Column:
        """Nearest grid point, halves to even."""
        if self.round_zero:
            return clamp(F.rint(value / pitch) + zero, self.low, self.high)
        return clamp(F.rint(value / F.greatest(pitch, F.lit(PITCH_FLOOR)) + zero), self.low, self.high)

    def value(self, code: Column, pitch: Column, zero: Column) -> Column:
        return (code - zero) * pitch

    def snap(self, value: Column, pitch: Column, zero: Column) -> Column:
        return self.value(self.code(value, pitch, zero), pitch, zero)


@dataclass(frozen=True)
class FloatFormat:
    """A floating-point grid pitched so that its largest number is the largest magnitude of the group."""

    exponent_bits: int
    mantissa_bits: int

    def bias(self, reach: Column) -> Column:
        m = self.mantissa_bits
        largest = 2.0 - 2.0 ** (-m)
        return F.lit(2.0**self.exponent_bits) - F.log2(reach) + F.log2(F.lit(largest)) - 1

    def pitch(self, value: Column, reach: Column, bias: Column) -> Column:
        """Distance of neighbouring grid points around ``value``."""
        clipped = F.least(F.greatest(value, -reach), reach)
        exponent = F.floor(F.log2(F.abs(clipped)) + bias).cast("double")
        exponent = F.greatest(F.coalesce(exponent, F.lit(1.0)), F.lit(1.0))
        return F.pow(F.lit(2.0), exponent - self.mantissa_bits - bias)

    def snap(self, value: Column, reach: Column, bias: Column) -> Column:
        step = self.pitch(value, reach, bias)
        clipped = F.least(F.greatest(value, -reach), reach)
        return F.rint(clipped / step) * step


# Floating-point formats by name (fixed values).
FLOAT_FORMATS = {
    "e4m3": FloatFormat(4, 3),
    "e5m2": FloatFormat(5, 2),
    "e3m2": FloatFormat(3, 2),
    "e4m7": FloatFormat(4, 7),
    "e2m1": FloatFormat(2, 1),
}


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))
