"""The seven signals of a quake stream and their fusion, over a whole table.

What a trailing window holds is the difference of two running totals, at the row and at the time where its
window begins. The second is looked up by laying, beside each row, a row at that time, so all that is done is
running totals over even slices of rows in order (``temblor.operators.slices``): a zone, a cell or an hour may
hold most of the table. Totals are whole numbers (counts, millionths of a degree, energies in units of 2^-45),
so windows are exact, and smoothing is folded in the order of rows from the exact state before them:
``temblor.streaming.state`` holds the same rules as a machine for one row at a time and gives the same bits.

Rows count in the order of time and id. A row without a magnitude counts as an event but has no energy, slope
or mainshock; one without a place belongs to no cell, so its cell's scores are 0, and stays out of barycentres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.functions import geo
from temblor.operators import slices
from temblor.operators.graph import stored

#: Fixed values of the signals: window lengths in microseconds, supports, smoothing factors, scales.
MINUTE = 60_000_000
FORESHOCK = {"window": 15 * MINUTE, "least": 5, "beta": 0.05, "scale": 3.0, "gap_alpha": 0.3}
TREND = {"rows": 6, "least": 4, "scale": 0.3}
ENERGY = {"window": 15 * MINUTE, "beta": 0.10, "scale": 4.0}
CLUSTER = {"window": 30 * MINUTE, "least": 4, "beta": 0.05, "scale": 3.0}
AFTERSHOCK = {"magnitude": 4.5, "window": 360 * MINUTE, "least": 5, "beta": 0.05, "scale": 3.0}
ASYMMETRY = {"window": 20 * MINUTE, "half": 10 * MINUTE, "least": 6, "scale": 2.0}
MIGRATION = {"window": 45 * MINUTE, "least": 5, "km": 30.0, "most_km": 80.0}
SIGNALS = ("foreshock", "trend", "energy", "asymmetry", "cluster", "migration", "aftershock")
WEIGHTS = {"foreshock": 0.25, "trend": 0.15, "energy": 0.20, "asymmetry": 0.15, "cluster": 0.10, "migration": 0.05}
ALERT, VIGILANCE, STRONG, QUIET = 0.75, 0.55, 0.7, 0.2
LOGGED = {name: 0.6 if name == "migration" else 0.7 for name in SIGNALS}
#: What is smoothed, and with which factor.
SMOOTHED = {"x15": FORESHOCK["beta"], "e15": ENERGY["beta"], "gap": FORESHOCK["gap_alpha"], "x30": CLUSTER["beta"]}
ORDER = ["us", "event_id", "uid"]
#: Energies are whole numbers of 2^-45, in two parts of 60 bits.
UNIT, PART = 45, 60


def signal_rows(quakes: DataFrame) -> DataFrame:
    """The columns that signals read, numbered by ``uid``; a place or magnitude that is no number is null."""
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    rows = quakes.filter(F.col("us").isNotNull()).select("event_id", "us", number("lat"), number("lon"), number("magnitude"), "region", "cell")
    cell = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("cell"))
    return stored(rows.withColumn("cell", cell).withColumn("uid", F.monotonically_increasing_id()), "signal-rows")


def looked_up(rows: DataFrame, keys: list[str], lengths: dict[str, int], sums: dict[str, Column]) -> tuple[DataFrame, bool]:
    """Rows (uid, part, event_id, us, magnitude, keys) with each running total at the row, and, as
    ``total_name``, over the rows that are more than a length older; and whether keys go over slices."""
    asked = [("", 0), *((f"_{n}", x) for n, x in lengths.items())]
    at = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(x).cast("long").alias("length")) for n, x in asked))
    inputs = {f"{n}_in": c for n, c in sums.items()}
    each = rows.select("uid", "event_id", "magnitude", *keys, "us", *(c.alias(n) for n, c in inputs.items()), F.explode(at).alias("at"))
    own = F.col("at.name") == ""
    each = each.withColumns({n: F.when(own, F.col(n)).otherwise(F.lit(0)) for n in inputs} | {"t": F.col("us") - F.col("at.length"), "own": own})
    each, spans = slices.dealt(each, keys, ["t", "own", "event_id", "uid"], rows.count() * (1 + len(lengths)), "signal-windows")
    found = slices.running(each, spans, keys, ["t", "own", "event_id", "uid"], {n: F.col(f"{n}_in") for n in sums})
    totals = [F.max(F.when(F.col("at.name") == suffix, F.col(n))).alias(n + suffix) for n in sums for suffix in ("", *(f"_{x}" for x in lengths))]
    row = F.max(F.when(F.col("own"), F.struct("part", "event_id", "us", "magnitude", *keys))).alias("row")
    found = found.groupBy("uid").agg(row, *totals)
    return found.select("uid", "row.*", *(n + suffix for n in sums for suffix in ("", *(f"_{x}" for x in lengths)))), spans


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def zone_windows(rows: DataFrame, names: set[str]) -> DataFrame:
    """(uid, ...) what the zone's windows hold and its smoothed values, for the signals of ``names``."""
    if not names & {"foreshock", "energy", "migration"}:  # no window of time: the rows alone
        found, spans = slices.dealt(rows.drop("cell", "lat", "lon"), ["region"], ORDER, rows.count(), "signal-zones")
        found = slices.running(found, spans, ["region"], ORDER, {"n": F.lit(1).cast("long")})
    else:
        lengths, sums = {}, {"n": F.lit(1).cast("long")}
        if names & {"foreshock", "energy"}:
            lengths["15"] = FORESHOCK["window"]
        if "energy" in names:
            e = F.coalesce(geo.energy(F.col("magnitude")), F.lit(0.0))
            high = F.floor(e / 2.0 ** (PART - UNIT))
            sums |= {"known": F.col("magnitude").isNotNull().cast("long"), "high": _exact(high), "low": _exact(F.floor((e - high * 2.0 ** (PART - UNIT)) * 2.0**UNIT))}
        if "migration" in names:
            lengths["45"] = MIGRATION["window"]
            placed = F.col("cell").isNotNull()
            micro = lambda c: _exact(F.when(placed, F.rint(F.col(c) * 1_000_000)).otherwise(0.0))
            sums |= {"placed": placed.cast("long"), "lats": micro("lat"), "lons": micro("lon")}
        found, spans = looked_up(rows, ["region"], lengths, sums)
    smooth, drop = {}, []
    if "foreshock" in names:
        found = found.withColumn("n15", F.col("n") - F.col("n_15")).withColumn("x15", F.when(F.col("n15") >= FORESHOCK["least"], F.col("n15").cast("double")))
        smooth["x15"] = SMOOTHED["x15"]
    if "energy" in names:
        units = (F.col("high") - F.col("high_15")) * F.lit(1 << PART).cast("decimal(20,0)") + (F.col("low") - F.col("low_15"))
        found = found.withColumn("e15", F.when(F.col("known") > F.col("known_15"), units.cast("double") * 2.0**-UNIT))
        smooth["e15"] = SMOOTHED["e15"]
        drop += ["high", "low", "high_15", "low_15"]
    if "migration" in names:
        found = _migrated(stored(found.drop(*drop), "signal-places"))
        drop = []
    if names & {"trend", "gap"} and spans:
        found = stored(found.drop(*drop), "signal-order")
    if "trend" in names:
        found = slices.earlier_value(found, spans, ["region"], ORDER, "magnitude", TREND["rows"] - 1, "n", "first_magnitude")
        steps = F.least(F.col("n"), F.lit(TREND["rows"])) - 1
        found = found.withColumn("raw_slope", F.when(steps >= TREND["least"] - 1, (F.col("magnitude") - F.col("first_magnitude")) / steps).otherwise(0.0)).drop("first_magnitude")
    if "gap" in names:
        found = slices.earlier_value(found, spans, ["region"], ORDER, "us", 1, "n", "us_before")
        found = found.withColumn("gap", F.when(F.col("n") > 1, (F.col("us") - F.col("us_before")) / 1e6)).drop("us_before")
        smooth["gap"] = SMOOTHED["gap"]
    keep = [c for c in ("n15", "x15", "e15", "raw_slope", "km", "gap") if c in found.columns]
    found = found.select("uid", "part", "region", "us", "event_id", *keep)
    if smooth:
        found = slices.folded(found, spans, ["region"], ORDER, slices.smoothing(smooth), {f"{c}_base": "double" for c in smooth}, "signal-smooth")
    return found.drop("part", "region", "us", "event_id")


def _migrated(found: DataFrame) -> DataFrame:
    """Adds ``km``: between the barycentres of the earlier and the later half of the places that the window holds."""
    at = found.filter(F.col("placed") > 0).groupBy("region", F.col("placed").alias("middle")).agg(F.max("lats").alias("lats_m"), F.max("lons").alias("lons_m"))
    n = F.col("placed") - F.col("placed_45")
    half = F.floor(n / 2)
    rows = found.withColumn("middle", F.when(n >= MIGRATION["least"], F.col("placed_45") + half)).join(at, ["region", "middle"], "left")
    mean = lambda a, b, count: (F.col(a) - F.col(b)).cast("long") / 1e6 / count
    km = geo.haversine_km(mean("lats_m", "lats_45", half), mean("lons_m", "lons_45", half), mean("lats", "lats_m", n - half), mean("lons", "lons_m", n - half))
    return rows.withColumn("km", F.when(n >= MIGRATION["least"], km).otherwise(0.0)).drop("middle", "lats_m", "lons_m", "lats", "lons", "lats_45", "lons_45", "placed", "placed_45")


def cell_windows(rows: DataFrame, names: set[str]) -> DataFrame:
    """(uid, ...) what the windows of rows' cells hold, for the signals of ``names``; rows without a cell are left out."""
    keys, lengths = ["region", "cell"], {}
    if "cluster" in names:
        lengths["30"] = CLUSTER["window"]
    if "asymmetry" in names:
        lengths |= {"20": ASYMMETRY["window"], "10": ASYMMETRY["half"]}
    found, spans = looked_up(rows.filter(F.col("cell").isNotNull()), keys, lengths, {"n": F.lit(1).cast("long")})
    found = found.withColumns({f"n{x}": F.col("n") - F.col(f"n_{x}") for x in lengths})
    if "aftershock" in names:
        found = _since_mainshock(stored(found, "signal-cells") if spans else found, spans, keys)
    if "cluster" not in names:
        return found.drop("part", *keys, "us", "event_id", "magnitude", "n")
    found = found.withColumn("x30", F.when(F.col("n30") >= CLUSTER["least"], F.col("n30").cast("double")))
    found = slices.folded(found, spans, keys, ORDER, slices.smoothing({"x30": SMOOTHED["x30"]}), {"x30_base": "double"}, "signal-smooth")
    return found.drop("part", *keys, "us", "event_id", "magnitude", "n")


def _since_mainshock(found: DataFrame, spans: bool, keys: list[str]) -> DataFrame:
    """Adds ``n_after``: how many rows a cell had in the hours after its last mainshock, up to the row. Both
    the last mainshock and the last such number are running maxima, for a cell's rows are numbered in order."""
    p = AFTERSHOCK
    found = slices.running(found, spans, keys, ORDER, maxima={"main": F.when(F.col("magnitude") >= p["magnitude"], F.struct(F.col("n").alias("n"), F.col("us").alias("us")))})
    inside = (F.col("n") > F.col("main.n")) & (F.col("us") - F.col("main.us") <= p["window"])
    after = F.when(F.col("main").isNotNull(), F.struct(F.col("main.n").alias("main"), F.when(inside, F.col("n") - F.col("main.n")).otherwise(0).alias("n")))
    found = slices.running(found, spans, keys, ORDER, maxima={"after": after})
    return found.withColumn("n_after", F.coalesce(F.col("after.n"), F.lit(0))).drop("main", "after")


def ratio_score(n: Column, base: Column, scale: float) -> Column:
    return F.when(n.isNotNull() & (base > 0), geo.half_even(F.least(n / base / scale, F.lit(1.0)))).otherwise(0.0)


def aftershock_steps() -> tuple[list[int], list[float]]:
    """Where the score changes with the number of rows after a mainshock, whose smoothing depends on the number
    alone, and what it is from there on; far beyond the last change the two grow alike."""
    p, base, firsts, scores = AFTERSHOCK, 0.0, [0], [0.0]
    for n in range(p["least"], 10_000):
        base = float(n) if n == p["least"] else p["beta"] * n + (1 - p["beta"]) * base
        score = round(min(n / base / p["scale"], 1.0) * 100) / 100
        if score != scores[-1]:
            firsts.append(n)
            scores.append(score)
    return firsts, scores


def _foreshock(rows: DataFrame) -> DataFrame:
    score = ratio_score(F.col("n15"), F.col("x15_base"), FORESHOCK["scale"])
    return rows.withColumn("foreshock", F.when(F.col("n15") >= FORESHOCK["least"], score).otherwise(0.0))


def _trend(rows: DataFrame) -> DataFrame:
    """The mean successive difference telescopes to last minus first over the differences' number."""
    score = F.when(F.col("raw_slope") > 0, geo.half_even(F.least(F.col("raw_slope") / TREND["scale"], F.lit(1.0)))).otherwise(0.0)
    return rows.withColumn("slope", geo.half_even(F.col("raw_slope"), 3)).withColumn("trend", score)


def _energy(rows: DataFrame) -> DataFrame:
    return rows.withColumn("energy", ratio_score(F.col("e15"), F.col("e15_base"), ENERGY["scale"]))


def _cluster(rows: DataFrame) -> DataFrame:
    score = ratio_score(F.col("n30"), F.col("x30_base"), CLUSTER["scale"])
    return rows.withColumn("cluster", F.when(F.col("n30") >= CLUSTER["least"], score).otherwise(0.0))


def _asymmetry(rows: DataFrame) -> DataFrame:
    p, old = ASYMMETRY, F.col("n20") - F.col("n10")
    rows = rows.withColumn("raw", F.when(F.col("n20") >= p["least"], F.when(old == 0, F.col("n10").cast("double")).otherwise(F.col("n10") / old)))
    score = F.when(F.col("raw").isNull(), 0.0).otherwise(geo.half_even(F.least(F.col("raw") / p["scale"], F.lit(1.0))))  # least() skips nulls
    return rows.withColumn("asymmetry_ratio", geo.half_even(F.col("raw"))).withColumn("asymmetry", score).drop("raw")


def _migration(rows: DataFrame) -> DataFrame:
    score = F.when(F.col("km") > MIGRATION["most_km"], 0.0).otherwise(geo.half_even(F.least(F.col("km") / MIGRATION["km"], F.lit(1.0))))
    return rows.withColumn("migration_km", geo.half_even(F.col("km"), 1)).withColumn("migration", score)


def _aftershock(rows: DataFrame) -> DataFrame:
    """Scores by the number of a cell's rows since its last mainshock, up to six hours after it; then the
    score stays what it was."""
    firsts, scores = aftershock_steps()
    step = F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x <= F.coalesce(F.col("n_after"), F.lit(0))))
    return rows.withColumn("aftershock", F.element_at(F.array(*map(F.lit, scores)), step))


STEPS = {"foreshock": _foreshock, "trend": _trend, "energy": _energy, "asymmetry": _asymmetry, "cluster": _cluster, "migration": _migration, "aftershock": _aftershock}
OF_CELLS = {"asymmetry", "cluster", "aftershock"}


def _scored(quakes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Quake rows with what the windows of some signals hold, and their scores."""
    wanted, rows = set(names), signal_rows(quakes)
    found = rows
    if wanted - OF_CELLS:
        found = found.join(zone_windows(rows, wanted - OF_CELLS), "uid")
    if wanted & OF_CELLS:
        found = found.join(cell_windows(rows, wanted & OF_CELLS), "uid", "left")
    for name in names:
        found = STEPS[name](found) if name in STEPS else found
    return found


def _alone(name: str):
    def signal(quakes: DataFrame) -> DataFrame:
        return _scored(quakes, (name,))

    signal.__name__, signal.__doc__ = name, STEPS[name].__doc__
    return signal


foreshock, trend, energy, asymmetry, cluster, migration, aftershock = map(_alone, STEPS)


def inter_event(quakes: DataFrame) -> DataFrame:
    """The smoothed seconds between a zone's events; null on its first."""
    return _scored(quakes, ("gap",)).withColumnRenamed("gap_base", "average_gap")


def fused(rows: DataFrame) -> DataFrame:
    """Adds global_score, level and strong_signals to rows with the seven scores."""
    weighted = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        weighted = weighted + F.lit(weight) * F.col(name)
    quiet = F.col("cluster") < QUIET
    strong = sum((F.when(F.col(name) >= STRONG, 1).otherwise(0) for name in SIGNALS), F.lit(0))
    rows = rows.withColumn("global_score", F.when(quiet, 0.0).otherwise(geo.half_even(weighted))).withColumn("strong_signals", F.when(~quiet, strong))
    level = F.when(quiet, "NONE").when(F.col("strong_signals") < 2, "LOW").when(F.col("global_score") >= ALERT, "ALERT").when(F.col("global_score") >= VIGILANCE, "VIGILANCE").otherwise("LOW")
    return rows.withColumn("level", level)


def all_signals(quakes: DataFrame) -> DataFrame:
    """Quake rows with all seven scores."""
    return _scored(quakes, SIGNALS).select("event_id", "us", "region", "cell", "magnitude", *SIGNALS)


def threshold_alerts(rows: DataFrame) -> DataFrame:
    """A row (event_id, region, signal, score) for each score above its logging threshold."""
    entries = F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("score"), F.lit(LOGGED[n]).alias("least")) for n in SIGNALS))
    return rows.select("event_id", "region", F.explode(entries).alias("s")).filter("s.score > s.least").select("event_id", "region", "s.signal", "s.score")
