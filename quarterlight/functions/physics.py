"""Wind, humidity and solar formulas as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, safe_ratio

# Dry-air gas constant, and Magnus coefficients over water.
GAS_CONSTANT = 287.05
MAGNUS = (6.1094, 17.625, 243.04)


def power_curve(speed: Column, cut_in: float = 3.0, rated: float = 12.0, cut_out: float = 25.0) -> Column:
    """Cubic ramp from cut-in to rated, 1 up to cut-out, else 0."""
    x = (speed - cut_in) / (rated - cut_in)
    return F.when((speed >= cut_in) & (speed < rated), x * x * x).when((speed >= rated) & (speed <= cut_out), 1.0).when(speed.isNotNull(), 0.0)


def smeared_power_curve(speed: Column, sigma: float) -> Column:
    """Expected power under a normal spread of the speed, by 7-node Gauss-Hermite quadrature."""
    nodes, weights = np.polynomial.hermite_e.hermegauss(7)
    total = None
    for node, weight in zip(nodes, weights / weights.sum(), strict=True):
        term = F.lit(float(weight)) * power_curve(clip(speed + F.lit(float(sigma * node)), 0.0))
        total = term if total is None else total + term
    return clip(total, 0.0, 1.0)


def shear(speed: Column, height: float, to: float, alpha: float = 1 / 7) -> Column:
    return speed * F.lit(float((to / height) ** alpha))


def hub_speed(s80: Column, s120: Column, hub: Column) -> Column:
    """Linear in height between 80 and 120 m, extrapolated by a bounded weight; an unknown hub is at 100 m."""
    weight = clip((F.coalesce(hub, F.lit(100.0)) - 80.0) / 40.0, -1.0, 2.5)
    return clip(s80 + weight * (s120 - s80), 0.0)


def air_density(pressure: Column, kelvin: Column) -> Column:
    return F.when(kelvin > 0, pressure / (GAS_CONSTANT * kelvin))


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """u, v from speed and the direction the wind comes from."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def vapour_pressure(celsius: Column) -> Column:
    a, b, c = MAGNUS
    return F.lit(a) * F.exp(F.lit(b) * celsius / (F.lit(c) + celsius))


def solar_position(ts: Column, latitude: Column | float, longitude: Column | float) -> dict[str, Column]:
    """cos_zenith, sin_zenith, elevation_deg, clear_sky, is_daylight, azimuth of the sun at a UTC instant."""
    lat = F.radians(F.lit(latitude) if not isinstance(latitude, Column) else latitude)
    lon = F.lit(longitude) if not isinstance(longitude, Column) else longitude
    minutes = F.hour(ts) * 60.0 + F.minute(ts) + F.second(ts) / 60.0
    g = F.lit(2 * math.pi / 365) * (F.dayofyear(ts) - 1.0 + (minutes / 60.0 - 12.0) / 24.0)
    c, s = (lambda k: F.cos(k * g)), (lambda k: F.sin(k * g))
    # Fourier coefficients of the equation of time and of the declination.
    equation = 229.18 * (0.000075 + 0.001868 * c(1) - 0.032077 * s(1) - 0.014615 * c(2) - 0.040849 * s(2))
    declination = 0.006918 - 0.399912 * c(1) + 0.070257 * s(1) - 0.006758 * c(2) + 0.000907 * s(2) - 0.002697 * c(3) + 0.00148 * s(3)
    hour_angle = F.radians(F.pmod(minutes + equation + 4.0 * lon, F.lit(1440.0)) / 4.0 - 180.0)
    cz = clip(F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(hour_angle), -1.0, 1.0)
    up = clip(cz, 0.0)
    azimuth = F.atan2(F.sin(hour_angle), F.cos(hour_angle) * F.sin(lat) - F.tan(declination) * F.cos(lat)) + math.pi
    return {
        "cos_zenith": cz, "sin_zenith": F.sqrt(clip(1 - cz * cz, 0.0)), "elevation_deg": F.degrees(F.asin(cz)), "clear_sky": F.pow(up, F.lit(1.25)),
        "is_daylight": (up > 0).cast("double"), "azimuth": azimuth,
    }


def module_efficiency(celsius: Column, irradiance: Column) -> Column:
    """Temperature factor of a photovoltaic module, bounded."""
    return clip(1.0 - 0.004 * (celsius + 0.025 * irradiance - 25.0), 0.75, 1.15)


def plane_irradiance(ghi: Column, direct: Column, diffuse: Column, sun: dict[str, Column], orientations: list[tuple[float, float, float]], albedo: float = 0.2) -> Column:
    """Irradiance on a mixture of (tilt, azimuth, weight) planes with an isotropic sky."""
    normal = clip(safe_ratio(direct, sun["cos_zenith"], 1e-4), 0.0, 1400.0)
    scale, total = sum(w for _, _, w in orientations), F.lit(0.0)
    for tilt, azimuth, weight in orientations:
        t, a = math.radians(tilt), math.radians(azimuth)
        incidence = clip(sun["cos_zenith"] * math.cos(t) + sun["sin_zenith"] * math.sin(t) * F.cos(sun["azimuth"] - a), 0.0)
        total = total + weight / scale * (normal * incidence + diffuse * (1 + math.cos(t)) / 2 + albedo * ghi * (1 - math.cos(t)) / 2)
    return clip(total, 0.0)
