"""The signals as machines that take quakes in order: the same rules as ``operators.signals``, to the bit.

A zone and a cell of it are machines of their own, so that each can be the state of its own key. They take rows
one by one or in pieces, with the same result. What slides is bounded by its window and lies in plain arrays:
counts are lengths, sums are differences of running totals, in whole numbers. A row without a magnitude or place
(null or NaN) counts as an event, but has no energy, slope, mainshock, cell or barycentre.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass, field

import numpy as np

from temblor.operators import signals as s


def half_even(x: float, digits: int = 2) -> float:
    scale = 10.0**digits
    return float(round(x * scale)) / scale + 0.0


def haversine_km(a: float, b: float, c: float, d: float) -> float:
    h = math.pow(math.sin(math.radians(c - a) / 2), 2) + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.pow(math.sin(math.radians(d - b) / 2), 2)
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@dataclass
class Smooth:
    """An exponential mean that begins with its first value."""

    beta: float
    value: float | None = None

    def add(self, x: float) -> float:
        self.value = x if self.value is None else self.beta * x + (1 - self.beta) * self.value
        return self.value


def known(x: float | None) -> float | None:
    return None if x is None or x != x else float(x)


def ratio(n: float, base: float, scale: float) -> float:
    return half_even(min(n / base / scale, 1.0)) if base > 0 else 0.0


def rounded(scores: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Scores of at most 1 with two decimals, half to even, and 0 elsewhere."""
    return np.where(where, np.rint(np.minimum(scores, 1.0) * 100.0) / 100.0 + 0.0, 0.0)


def ratios(n: np.ndarray, where: np.ndarray, smooth: Smooth, scale: float) -> np.ndarray:
    """``ratio`` to the smoothed value for the rows that count, which go into it in their order."""
    out = np.zeros(len(n))
    x = n[where].astype(float)
    if len(x):
        base = np.array([smooth.add(v) for v in x.tolist()])
        with np.errstate(divide="ignore", invalid="ignore"):
            out[where] = rounded(x / base / scale, base > 0)
    return out


def first_held(times: np.ndarray, since: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where each row's window begins in the rows that came so far, of which ``before`` came before it. Rows leave
    in the order in which they came; ``since`` does not decrease."""
    return np.minimum(np.searchsorted(np.maximum.accumulate(times), since, "left"), before)


def joined(held: array, new: np.ndarray) -> np.ndarray:
    return np.concatenate([np.frombuffer(held, held.typecode), new]) if len(held) else np.asarray(new, held.typecode)


def packed(kind: str, values: np.ndarray) -> array:
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values, kind).tobytes())
    return out


Times = lambda: array("q")


@dataclass
class Cell:
    """What a cell of a zone remembers: the times of its last half hour, smoothing, its last mainshock."""

    recent: array = field(default_factory=Times)
    base: Smooth = field(default_factory=lambda: Smooth(s.CLUSTER["beta"]))
    since: int | None = None
    after: int = 0
    after_base: Smooth = field(default_factory=lambda: Smooth(s.AFTERSHOCK["beta"]))
    after_score: float = 0.0

    def add(self, us: int, magnitude: float | None) -> dict[str, float]:
        found = self.add_many(np.array([us]), np.array([np.nan if magnitude is None else magnitude]))
        return {name: float(x[0]) for name, x in found.items()}

    def add_many(self, us: np.ndarray, magnitude: np.ndarray) -> dict[str, np.ndarray]:
        """The scores of rows in order of time; a magnitude that is not known is NaN."""
        times, before = joined(self.recent, us), len(self.recent) + np.arange(len(us))
        counts = {}
        for name, length in (("n", s.CLUSTER["window"]), ("half", s.ASYMMETRY["window"]), ("late", s.ASYMMETRY["half"])):
            first = first_held(times, us - length, before)
            counts[name] = before + 1 - first
            if name == "n":
                self.recent = packed("q", times[first[-1] :])
        cluster = ratios(counts["n"], counts["n"] >= s.CLUSTER["least"], self.base, s.CLUSTER["scale"])
        late, old = counts["late"].astype(float), counts["half"] - counts["late"]
        asymmetry = rounded(np.where(old > 0, late / np.maximum(old, 1), late) / s.ASYMMETRY["scale"], counts["half"] >= s.ASYMMETRY["least"])
        aftershock = np.array([self._aftershock(t, m) for t, m in zip(us.tolist(), magnitude.tolist(), strict=True)])
        return {"cluster": cluster, "asymmetry": asymmetry, "aftershock": aftershock}

    def _aftershock(self, us: int, magnitude: float) -> float:
        p = s.AFTERSHOCK
        if magnitude >= p["magnitude"]:
            self.since, self.after, self.after_base, self.after_score = us, 0, Smooth(p["beta"]), 0.0
        elif self.since is not None and us - self.since <= p["window"]:
            self.after += 1
            self.after_score = ratio(self.after, self.after_base.add(float(self.after)), p["scale"]) if self.after >= p["least"] else 0.0
        return self.after_score

    def last(self) -> int | None:
        return self.recent[-1] if self.recent else None

    def expire(self, us: int) -> bool:
        """Drops what no row from this time on can see; whether nothing is left that could change a score."""
        first = next((i for i, t in enumerate(self.recent) if us - t <= s.CLUSTER["window"]), len(self.recent))
        del self.recent[:first]
        return not self.recent and self.base.value is None and self.since is None

    def kept(self) -> tuple[tuple, array]:
        """The state as a row and times."""
        return (self.base.value, self.since, self.after, self.after_base.value, self.after_score), self.recent[:]

    @classmethod
    def of(cls, row: tuple | None, times: array) -> Cell:
        cell = cls(recent=times[:])
        if row is not None:
            cell.base.value, cell.since, cell.after, cell.after_base.value, cell.after_score = row
        return cell


UNITS = 2**s.UNIT
#: What a zone holds and of which type: the times of its last rows, those with a magnitude and their energies, those
#: with a place and the places in millionths, its last magnitudes.
HELD = {"times": "q", "energy_times": "q", "energies": "d", "place_times": "q", "lats": "q", "lons": "q", "magnitudes": "d"}


@dataclass
class Zone:
    """What a zone remembers: what its windows hold, at 24 bytes a row of the last 45 minutes and 24 of the last
    15, its last magnitudes, smoothing."""

    held: dict[str, array] = field(default_factory=lambda: {name: array(kind) for name, kind in HELD.items()})
    base: Smooth = field(default_factory=lambda: Smooth(s.FORESHOCK["beta"]))
    energy_base: Smooth = field(default_factory=lambda: Smooth(s.ENERGY["beta"]))
    cells: dict[str, Cell] = field(default_factory=dict)

    def add(self, us: int, lat: float | None, lon: float | None, cell: str | None, magnitude: float | None) -> dict[str, float]:
        """All scores of a row, with the zone's cells beside it."""
        found = self.add_zone(us, lat, lon, magnitude)
        placed = known(lat) is not None and known(lon) is not None and cell is not None
        own = self.cells.setdefault(cell, Cell()).add(us, known(magnitude)) if placed else dict.fromkeys(("cluster", "asymmetry", "aftershock"), 0.0)
        return found | own

    def add_zone(self, us: int, lat: float | None, lon: float | None, magnitude: float | None) -> dict[str, float]:
        """The scores of the zone alone."""
        lat, lon, magnitude = (np.array([np.nan if x is None else x]) for x in (lat, lon, magnitude))
        found = self.add_many(np.array([us]), lat, lon, magnitude, np.array([math.pow(10.0, 1.5 * m + 4.8) for m in magnitude]))
        return {name: float(x[0]) for name, x in found.items()}

    def add_many(self, us: np.ndarray, lat: np.ndarray, lon: np.ndarray, magnitude: np.ndarray, energy: np.ndarray) -> dict[str, np.ndarray]:
        """The zone's scores of rows in order of time; what is not known is NaN."""
        before = len(self.held["times"]) + np.arange(len(us))
        times = joined(self.held["times"], us)
        first = first_held(times, us - s.FORESHOCK["window"], before)
        self.held["times"] = packed("q", times[first[-1] :])
        n = before + 1 - first
        foreshock = ratios(n, n >= s.FORESHOCK["least"], self.base, s.FORESHOCK["scale"])
        return {"foreshock": foreshock, "trend": self._trend(magnitude), "energy": self._energy(us, ~np.isnan(magnitude), energy), "migration": self._migration(us, lat, lon)}

    def _trend(self, magnitude: np.ndarray) -> np.ndarray:
        last = joined(self.held["magnitudes"], magnitude)
        self.held["magnitudes"] = packed("d", last[-s.TREND["rows"] :])
        at = len(last) - len(magnitude) + np.arange(len(magnitude))
        steps = np.minimum(at, s.TREND["rows"] - 1)
        slope = (magnitude - last[at - steps]) / np.maximum(steps, 1)
        return rounded(slope / s.TREND["scale"], (steps >= s.TREND["least"] - 1) & (slope > 0))

    def _window(self, times: str, us: np.ndarray, own: np.ndarray, length: int, **columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Of the rows ``own`` and those held before: where each row's window begins and ends, and the columns. What
        the last window holds is held further."""
        held = len(self.held[times])
        end = held + np.cumsum(own)
        each = {name: joined(self.held[name], x[own]) for name, x in ({times: us} | columns).items()}
        first = first_held(each[times], us - length, end - own)
        for name, x in each.items():
            self.held[name] = packed(HELD[name], x[first[-1] :])
        return first, end, each

    def _energy(self, us: np.ndarray, own: np.ndarray, energy: np.ndarray) -> np.ndarray:
        first, end, each = self._window("energy_times", us, own, s.ENERGY["window"], energies=energy)
        totals, total, a, b = [], 0, 0, 0
        units = [int(e * UNITS) for e in each["energies"].tolist()]
        for low, high in zip(first.tolist(), end.tolist(), strict=True):
            total += sum(units[b:high]) - sum(units[a:low])
            a, b = low, high
            totals.append(total / UNITS)
        return ratios(np.array(totals), end > first, self.energy_base, s.ENERGY["scale"])

    def _migration(self, us: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        p = s.MIGRATION
        own = ~(np.isnan(lat) | np.isnan(lon))
        micro = lambda x: np.rint(np.where(own, x, 0.0) * 1_000_000).astype("q")
        first, end, each = self._window("place_times", us, own, p["window"], lats=micro(lat), lons=micro(lon))
        out = np.zeros(len(us))
        where = end - first >= p["least"]
        if where.any():
            low, high = first[where], end[where]
            middle = low + (high - low) // 2
            totals = [np.concatenate([[0], np.cumsum(each[name])]) for name in ("lats", "lons")]
            means = [((t[b] - t[a]) / 1e6 / (b - a)).tolist() for a, b in ((low, middle), (middle, high)) for t in totals]
            km = np.array([haversine_km(*x) for x in zip(*means, strict=True)])
            out[where] = rounded(km / p["km"], km <= p["most_km"])
        return out

    def kept(self) -> tuple[tuple, dict[str, array]]:
        """The state as a row, and what the windows hold."""
        return (self.base.value, self.energy_base.value), self.held

    @classmethod
    def of(cls, row: tuple | None, held: dict[str, array]) -> Zone:
        zone = cls()
        zone.held |= held
        if row is not None:
            zone.base.value, zone.energy_base.value = row
        return zone


def fused(row: dict[str, float]) -> tuple[float, str, int | None]:
    """(global score, level, strong signals) of seven scores."""
    if row["cluster"] < s.QUIET:
        return 0.0, "NONE", None
    total = 0.0
    for n, w in s.WEIGHTS.items():  # in this order, uncompensated: sum() would differ in the last bit
        total += w * row[n]
    score = half_even(total)
    strong = sum(row[n] >= s.STRONG for n in s.SIGNALS)
    level = "LOW" if strong < 2 else "ALERT" if score >= s.ALERT else "VIGILANCE" if score >= s.VIGILANCE else "LOW"
    return score, level, strong
