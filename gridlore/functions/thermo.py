"""Saturation and phase functions of temperature, and the condensation step, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constants:
    """Standard physical constants of atmospheric models."""

    rtt: float = 273.16
    rtice: float = 250.16
    rtwat: float = 273.16
    r2es: float = 380.16
    r3les: float = 17.502
    r3ies: float = 22.587
    r4les: float = 32.19
    r4ies: float = -0.7
    rlvtt: float = 2.5008e6
    rlstt: float = 2.8345e6
    rcpd: float = 1004.709
    retv: float = 0.6078
    rthomo: float = 235.16
    rlmin: float = 1e-8
    rkoop1: float = 2.583
    rkoop2: float = 0.48116e-2

    @property
    def r5les(self) -> float:
        return self.r3les * (self.rtt - self.r4les)

    @property
    def r5ies(self) -> float:
        return self.r3ies * (self.rtt - self.r4ies)

    @property
    def ralvdcp(self) -> float:
        return self.rlvtt / self.rcpd

    @property
    def ralsdcp(self) -> float:
        return self.rlstt / self.rcpd


class Thermo:
    def __init__(self, c: Constants = Constants()):  # noqa: B008  frozen
        self.c = c

    def above_melting(self, t: Column) -> Column:
        return F.when(t > self.c.rtt, 1.0).otherwise(0.0)

    def liquid_share(self, t: Column) -> Column:
        """Share of water in mixed phase: a clamped, squared ramp between two temperatures."""
        c = self.c
        ramp = (F.greatest(F.lit(c.rtice), F.least(F.lit(c.rtwat), t)) - c.rtice) * (1 / (c.rtwat - c.rtice))
        return F.least(F.lit(1.0), ramp * ramp)

    def over_water(self, t: Column) -> Column:
        return self.c.r2es * F.exp(self.c.r3les * (t - self.c.rtt) / (t - self.c.r4les))

    def over_ice(self, t: Column) -> Column:
        return self.c.r2es * F.exp(self.c.r3ies * (t - self.c.rtt) / (t - self.c.r4ies))

    def over_mixed(self, t: Column) -> Column:
        a = self.liquid_share(t)
        return a * self.over_water(t) + (1.0 - a) * self.over_ice(t)

    def slope_mixed(self, t: Column) -> Column:
        a, c = self.liquid_share(t), self.c
        return a * (c.r5les * c.ralvdcp) / F.pow(t - c.r4les, F.lit(2.0)) + (1.0 - a) * (c.r5ies * c.ralsdcp) / F.pow(t - c.r4ies, F.lit(2.0))

    def heat_mixed(self, t: Column) -> Column:
        a = self.liquid_share(t)
        return a * self.c.rlvtt + (1.0 - a) * self.c.rlstt

    def heating_mixed(self, t: Column) -> Column:
        a = self.liquid_share(t)
        return a * self.c.ralvdcp + (1.0 - a) * self.c.ralsdcp

    def heat(self, t: Column) -> Column:
        return F.when(t > self.c.rtt, self.c.rlvtt).otherwise(self.c.rlstt)

    def heating(self, t: Column) -> Column:
        return F.when(t > self.c.rtt, self.c.ralvdcp).otherwise(self.c.ralsdcp)

    def saturation(self, t: Column) -> Column:
        return F.when(t > self.c.rtt, self.over_water(t)).otherwise(self.over_ice(t))

    def slope(self, t: Column) -> Column:
        c = self.c
        water = (c.r5les * c.ralvdcp) / F.pow(t - c.r4les, F.lit(2.0))
        return F.when(t > c.rtt, water).otherwise((c.r5ies * c.ralsdcp) / F.pow(t - c.r4ies, F.lit(2.0)))

    def relative_slope(self, t: Column) -> Column:
        """Of the logarithm of saturation pressure, over water or ice."""
        c = self.c
        return F.when(t > c.rtt, c.r5les / F.pow(t - c.r4les, F.lit(2.0))).otherwise(c.r5ies / F.pow(t - c.r4ies, F.lit(2.0)))

    def relative_slope_mixed(self, t: Column) -> Column:
        a, c = self.liquid_share(t), self.c
        return a * c.r5les / F.pow(t - c.r4les, F.lit(2.0)) + (1.0 - a) * c.r5ies / F.pow(t - c.r4ies, F.lit(2.0))

    def pressure_slope_mixed(self, t: Column) -> Column:
        """Of saturation pressure in mixed phase, by temperature, at a fixed share of water."""
        a, c = self.liquid_share(t), self.c
        return a * self.over_water(t) * c.r5les / F.pow(t - c.r4les, F.lit(2.0)) + (1.0 - a) * self.over_ice(t) * c.r5ies / F.pow(t - c.r4ies, F.lit(2.0))

    def convective(self, ice_from: float = 250.16) -> Thermo:
        """The same functions with the ramp of convective clouds."""
        return Thermo(replace(self.c, rtice=ice_from))

    def freezing_limit(self, t: Column) -> Column:
        return F.least(self.c.rkoop1 - self.c.rkoop2 * t, self.over_water(t) / self.over_ice(t))

    def condensed(self, cover: Column, change: Column, saturated: Column, vapour: Column, t: Column) -> Column:
        """Water that condenses in a cell in one step; 0 where the conditions are not met."""
        c = self.c
        correction = 1.0 / (1.0 - c.retv * saturated)
        whole = (vapour - saturated) / (1.0 + correction * saturated * self.slope_mixed(t))
        part = F.try_divide(vapour - cover * saturated, cover)
        limit = F.when(cover > 0.99, whole).otherwise(part)
        lc = cover * F.greatest(F.least(F.greatest(-change, F.lit(0.0)), limit), F.lit(0.0))
        return F.when((cover > 1e-14) & (change <= -c.rlmin) & (lc >= c.rlmin), lc).otherwise(0.0)
