"""Columns from complex phase-contrast signals.  Spark has no complex type: a value is a pair (re, im)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Density of blood in kg/m3, as the load step fixes it.
RHO = 1060.0


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def phase_difference(re: Column, im: Column, ref_re: Column, ref_im: Column) -> Column:
    """Angle of value * conj(reference), in (-pi, pi]."""
    return F.atan2(im * ref_re - re * ref_im, re * ref_re + im * ref_im)


def velocity(phase: Column, venc: Column | float) -> Column:
    """cm/s from phase: venc is the velocity at pi."""
    return phase / F.pi() * venc


def intravoxel_sigma(ref: Column, enc: Column, venc: Column | float) -> Column:
    """Spread of velocities inside a voxel from the loss of magnitude; undefined values are 0."""
    ratio = F.greatest(ref / F.greatest(enc, F.lit(1e-12)), F.lit(1.0))
    sigma = F.sqrt(2.0 * F.ln(ratio)) * venc / F.pi()
    return F.when(F.isnan(sigma) | (sigma == float("inf")) | sigma.isNull(), 0.0).otherwise(sigma)


def kinetic_energy(sx: Column, sy: Column, sz: Column, rho: float = RHO) -> Column:
    """Turbulent kinetic energy in J/m3 from the spreads in cm/s."""
    return 0.5 * rho * ((sx / 100) * (sx / 100) + (sy / 100) * (sy / 100) + (sz / 100) * (sz / 100))


def speed(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)
