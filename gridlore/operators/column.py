"""Single-column cloud microphysics: supersaturation, erosion of clouds, condensation, deposition, autoconversion to snow
and rain, melting, freezing, evaporation of precipitation, sedimentation, and the implicit update of the five water
species.

Levels depend on the level above through the falling fluxes, so a column stays together; columns don't depend
on each other and go in blocks, which are one array operation per level.  Not covered: convective detrainment and
subsidence, size distributions of ice and snow, and the aerosol variants.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions.thermo import Constants

LIQUID, ICE, RAIN, SNOW, VAPOUR = range(5)
TINY = 1e-14


@dataclass(frozen=True)
class Scheme:
    """Time step, conversion rates and thresholds, fall speeds; gravity turns pressure into mass."""

    dt: float = 600.0
    gravity: float = 9.80665
    snow_rate: float = 1e-3
    snow_growth: float = 0.025
    snow_limit: float = 3e-5
    rain_rate: float = 1e-4
    rain_limit: float = 3e-4
    collection: float = 100.0
    melting_time: float = 11_800.0
    fall: tuple[float, ...] = (0.0, 0.15, 4.0, 1.0, 0.0)
    erosion: float = 3e-6
    gas_vapour: float = 461.5
    gas_ratio: float = 0.621981
    first_ice: float = 1e-12
    top_cover: float = 0.01
    top_rate: float = 0.1
    top_depth: float = 500.0
    drops: float = 8e6
    bigg: tuple[float, float] = (0.66, 100.0)
    mostly_rain: float = 0.8
    dry_limit: float = 0.7
    evaporation: tuple[float, float] = (5.44e-4, 5.09e-3)
    least_wet: float = 0.1
    thermo: Constants = field(default_factory=Constants)

    def run(self, q: np.ndarray, t: np.ndarray, cover: np.ndarray, dp: np.ndarray, rho: np.ndarray, saturated: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, ...]:
        """q (species, level, column) and fields (level, column), the top level first.  Returns the new q, the new
        t, and the fluxes through the lower border of each level (species, level, column)."""
        c, new, heat, flux = self.thermo, q.copy(), t.copy(), np.zeros_like(q)
        falling = np.zeros((5, q.shape[2]))
        ground = dp.sum(0)
        pressure = np.cumsum(dp, 0) - dp / 2
        above, depth, wet = np.zeros(q.shape[2]), np.zeros(q.shape[2]), np.zeros(q.shape[2])  # cover above, way from the cloud's top, share under precipitation
        for k in range(q.shape[1]):
            now, temp = q[:, k].copy(), t[k]
            depth = np.where((above < self.top_cover) & (cover[k] >= self.top_cover), 0, depth + dp[k] / (rho[k] * self.gravity))
            wet = np.where(falling.sum(0) > TINY, np.clip(1 - (1 - wet) * (1 - np.maximum(cover[k], above)) / (1 - np.minimum(above, 1 - 1e-6)), self.least_wet, 1), 0)
            above = cover[k]
            moves, rates = np.zeros((5, 5, q.shape[2])), np.zeros((5, 5, q.shape[2]))  # [from, to]: amounts, and shares a step
            per = self.dt * self.gravity / dp[k]
            arrived = falling * per
            now += arrived
            self._supersaturate(moves, now, temp, cover[k], pressure[k])
            self._erode(moves, now, temp, cover[k], saturated[k])
            self._condense(moves, now, temp, cover[k], saturated[k], change[k])
            self._deposit(moves, now, temp, cover[k], pressure[k], rho[k], depth)
            self._convert(rates, now, temp, np.maximum(cover[k], 1e-6), falling)
            self._melt(moves, now, temp)
            self._freeze(moves, now, temp, rho[k])
            wet = self._evaporate(moves, now, temp, cover[k], pressure[k], ground, dp[k], wet)
            self._limit(moves, q[:, k] + arrived)
            sink = per * np.array(self.fall)[:, None] * rho[k]
            left = self._solve(q[:, k] + arrived + moves.sum(0) - moves.sum(1), rates, sink)
            for s in (LIQUID, ICE, RAIN, SNOW):  # traces turn to vapour
                trace = left[s] < TINY
                left[VAPOUR] += np.where(trace, left[s], 0)
                left[s] = np.where(trace, 0, left[s])
            falling = left * sink / per
            gain = left - q[:, k] - arrived + left * sink  # by phase change alone
            heat[k] = temp + (c.ralvdcp * (gain[LIQUID] + gain[RAIN]) + c.ralsdcp * (gain[ICE] + gain[SNOW]))
            new[:, k], flux[:, k] = left, falling
        return new, heat, flux

    def saturations(self, t: np.ndarray, pressure: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """Over water and over ice (water above melting): the saturation humidity, and how much more has to condense as the
        air warms by it."""
        c = self.thermo
        water = c.r3les * (t - c.rtt) / (t - c.r4les)
        ice = np.where(t > c.rtt, water, c.r3ies * (t - c.rtt) / (t - c.r4ies))
        out = []
        for power, b, five, heat in ((water, c.r4les, c.r5les, c.ralvdcp), (ice, c.r4ies, c.r5ies, c.ralsdcp)):
            raw = np.minimum(c.r2es * np.exp(power) / pressure, 0.5)
            q = raw / (1 - c.retv * raw)
            out.append((q, 1 + heat * five / (t - b) ** 2 / (1 - c.retv * raw) * q))
        return tuple(out)

    def koop(self, t: np.ndarray) -> np.ndarray:
        """How far ice may be oversaturated: up to homogeneous freezing, or to saturation over water."""
        c = self.thermo
        water, ice = c.r3les * (t - c.rtt) / (t - c.r4les), c.r3ies * (t - c.rtt) / (t - c.r4ies)
        return np.minimum(c.rkoop1 - c.rkoop2 * t, np.exp(water - ice))

    def _supersaturate(self, moves, now, t, cover, pressure):
        """Vapour above the limit becomes water, or ice where it is too cold for that."""
        c, (_, (ice, more)) = self.thermo, self.saturations(t, pressure)
        limit = np.where(t >= c.rtt, 1, cover + self.koop(t) * (1 - cover)) * ice
        clear = (now[VAPOUR] - cover * ice) / np.maximum(1 - cover, TINY)
        amount = np.maximum(np.where(cover > 1 - 1e-8, now[VAPOUR] - limit, (1 - cover) * (clear - limit)) / more, 0)
        amount = np.where(amount > TINY, amount, 0)
        for s, here in ((LIQUID, t > c.rthomo), (ICE, t <= c.rthomo)):
            moves[VAPOUR, s] += np.where(here, amount, 0)
            now[s] += np.where(here, amount, 0)

    def _erode(self, moves, now, t, cover, saturated):
        """Mixing with dry air takes water and ice from clouds, by their shares."""
        cloud = now[LIQUID] + now[ICE]
        dry = np.maximum(saturated - now[VAPOUR], 0)
        amount = np.where(cloud > TINY, np.minimum(np.minimum(cover * self.erosion * self.dt * dry, dry), cloud), 0)
        for s in (LIQUID, ICE):
            moves[s, VAPOUR] += amount * now[s] / np.maximum(cloud, TINY)

    def _deposit(self, moves, now, t, cover, pressure, rho, depth):
        """Ice grows at the cost of water in clouds below freezing, more slowly near their top."""
        c = self.thermo
        cold = (t < c.rtt) & (now[LIQUID] > c.rlmin)
        t = np.where(cold, t, c.rtt - 10)
        ice = c.r2es * np.exp(c.r3ies * (t - c.rtt) / (t - c.r4ies)) / self.gas_ratio
        water = ice * self.koop(t)
        nuclei = 1000 * np.exp(12.96 * (water - ice) / water - 0.639)
        conducted = c.rlstt * (c.rlstt / (self.gas_vapour * t) - 1) / (2.4e-2 * t)
        diffused = self.gas_vapour * t * pressure / (2.21 * ice)
        growth = 7.8 * (nuclei / rho) ** 0.666 * (water - ice) / (8.87 * (conducted + diffused) * ice)
        inside = np.maximum(cover, 1e-6)
        first = np.maximum(now[ICE] / inside, nuclei * self.first_ice / rho)
        amount = np.minimum(np.maximum(cover * ((0.666 * growth * self.dt + first**0.666) ** 1.5 - first), 0), now[LIQUID])
        many = np.minimum(nuclei / 15000, 1)
        amount = np.where(cold, amount * np.minimum(many + (1 - many) * (self.top_rate + depth / self.top_depth), 1), 0)
        moves[LIQUID, ICE] += amount
        now[ICE] += amount
        now[LIQUID] -= amount

    def _freeze(self, moves, now, t, rho):
        """Rain to snow below freezing: whole drops slowly by their size, half melted flakes as fast as they melt; water to
        ice where it freezes by itself."""
        c = self.thermo
        below, rain = np.maximum(c.rtt - t, 0), np.maximum(now[RAIN], TINY)
        slope = (np.pi * 1000 * self.drops / (rho * rain)) ** 0.25
        slow = self.dt * 20 * np.pi**2 * self.bigg[1] * self.drops * (1000 / rho) * np.expm1(np.minimum(self.bigg[0] * below, 50)) / slope**7
        fast = below * np.abs(self.dt * (1 + 0.5 * below) / self.melting_time) / (c.ralsdcp - c.ralvdcp)
        most = np.where(now[RAIN] > self.mostly_rain * np.maximum(now[RAIN] + now[SNOW], TINY), slow, fast)
        moves[RAIN, SNOW] += np.where(now[RAIN] > TINY, np.minimum(now[RAIN], most), 0)
        moves[LIQUID, ICE] += np.minimum(np.maximum(now[LIQUID], 0), np.maximum(c.rthomo - t, 0) / (c.ralsdcp - c.ralvdcp))

    def _evaporate(self, moves, now, t, cover, pressure, ground, dp, wet):
        """Precipitation that falls through the clear part of its share, rain and then snow; returns what stays wet."""
        for s, (q, more) in zip((RAIN, SNOW), self.saturations(t, pressure), strict=True):
            clear = np.maximum(wet - cover, 0)
            limit = np.clip(self.dry_limit + (1 - self.dry_limit) * wet / np.maximum(1 - cover, TINY), self.dry_limit, 1)
            around = np.clip((now[VAPOUR] - cover * q) / np.maximum(1 - cover, TINY), 0, q)
            goes = (clear > TINY) & (now[s] > TINY) & (around < limit * q)
            rate = now[s] * dp / (self.gravity * self.dt) / np.maximum(wet, TINY)  # what falls, by area under it
            beta = self.evaporation[0] * 0.5 * (np.sqrt(pressure / ground) / self.evaporation[1] * np.maximum(rate, 0)) ** 0.5777
            amount = np.where(goes, np.minimum(clear * beta * self.dt * (q - around) / (1 + beta * self.dt * more), np.maximum(now[s], 0)), 0)
            moves[s, VAPOUR] += amount
            wet = np.where(goes, np.maximum(self.least_wet, wet - np.maximum(0, (wet - cover) * amount / np.maximum(now[s], TINY))), wet)
            now[s] -= amount
        return wet

    def _condense(self, moves, now, t, cover, saturated, change):
        c = self.thermo
        share = np.minimum(1, ((np.clip(t, c.rtice, c.rtwat) - c.rtice) / (c.rtwat - c.rtice)) ** 2)
        slope = share * c.r5les * c.ralvdcp / (t - c.r4les) ** 2 + (1 - share) * c.r5ies * c.ralsdcp / (t - c.r4ies) ** 2
        whole = (now[VAPOUR] - saturated) / (1 + saturated / (1 - c.retv * saturated) * slope)
        part = (now[VAPOUR] - cover * saturated) / np.maximum(cover, TINY)
        amount = cover * np.maximum(np.minimum(np.maximum(-change, 0), np.where(cover > 0.99, whole, part)), 0)
        amount = np.where((cover > TINY) & (change <= -c.rlmin) & (amount >= c.rlmin), amount, 0)
        warm = t > c.rthomo
        for s, here in ((LIQUID, warm), (ICE, ~warm)):
            moves[VAPOUR, s] += np.where(here, amount, 0)
            now[s] += np.where(here, amount, 0)

    def _convert(self, rates, now, t, cover, falling):
        c = self.thermo
        ice, liquid, cold = now[ICE] / cover, now[LIQUID] / cover, t <= c.rtt
        grow = self.dt * self.snow_rate * np.exp(self.snow_growth * (t - c.rtt))
        rates[ICE, SNOW] = np.where(cold & (ice > TINY), grow * (1 - np.exp(-np.minimum((ice / self.snow_limit) ** 2, 700))), 0)
        boost = 1 + self.collection * np.sqrt(np.maximum(falling[RAIN] + falling[SNOW], 0) / cover)
        ratio = liquid * boost / self.rain_limit
        rain = np.where(liquid > TINY, self.dt * self.rain_rate * boost * (1 - np.exp(-np.minimum(ratio**2, 400))), 0)
        rates[LIQUID, SNOW], rates[LIQUID, RAIN] = np.where(cold, rain, 0), np.where(cold, 0, rain)

    def _melt(self, moves, now, t):
        c = self.thermo
        frozen, over = now[ICE] + now[SNOW], t - c.rtt
        most = np.maximum(over * np.abs(self.dt * (1 + 0.5 * over) / self.melting_time) / (c.ralsdcp - c.ralvdcp), 0)
        can = (frozen > TINY) & (over > 0) & (most > TINY)
        for s, into in ((ICE, LIQUID), (SNOW, RAIN)):
            moves[s, into] += np.where(can, np.minimum(now[s], now[s] / np.where(frozen > 0, frozen, 1) * most), 0)

    @staticmethod
    def _limit(moves, there):
        """No species gives away more than it has, its own gains counted."""
        for s in range(5):
            out = moves[s].sum(0)
            have = np.maximum(there[s] + moves[:, s].sum(0), 0)
            moves[s] *= np.where(out > have, have / np.where(out > 0, out, 1), 1)

    @staticmethod
    def _solve(right, rates, sink):
        """(1 + sink + all rates out) q - rates in = right, for every column at once."""
        left = -np.moveaxis(rates, 2, 0).transpose(0, 2, 1)  # row: to, column: from
        diagonal = 1 + sink + rates.sum(1)
        left[:, range(5), range(5)] += diagonal.T
        return np.linalg.solve(left, right.T[:, :, None])[:, :, 0].T


def microphysics(levels: DataFrame, scheme: Scheme = Scheme(), block: int = 256) -> DataFrame:  # noqa: B008  frozen
    """Columns (jl, jk, t, cover, dp, rho, saturated, change, liquid, ice, rain, snow, vapour) one step on.

    Returns jl, jk, t, the five species, and rain and snow that fall out of each level.  All columns need the
    same levels, counted from the top.
    """
    species = ("liquid", "ice", "rain", "snow", "vapour")
    schema = "jl long, jk int, t double, " + ", ".join(f"{s} double" for s in species) + ", rain_flux double, snow_flux double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["jk", "jl"])
        shape = pdf["jk"].nunique(), pdf["jl"].nunique()
        if shape[0] * shape[1] != len(pdf):
            raise ValueError("every column needs each level once")
        grid = lambda c: pdf[c].to_numpy(float).reshape(shape)
        q, t, flux = scheme.run(np.stack([grid(s) for s in species]), *(grid(c) for c in ("t", "cover", "dp", "rho", "saturated", "change")))
        out = {"jl": pdf["jl"].to_numpy(), "jk": pdf["jk"].to_numpy(), "t": t.ravel()}
        out |= {s: q[k].ravel() for k, s in enumerate(species)}
        return pd.DataFrame(out | {"rain_flux": flux[RAIN].ravel(), "snow_flux": flux[SNOW].ravel()})

    return levels.withColumn("_block", F.floor(F.col("jl") / block)).groupBy("_block").applyInPandas(run, schema)
