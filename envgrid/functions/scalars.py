"""Column builders for the scores, indices and conversions. Missing values are NULL; NaN is turned into NULL at the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from envgrid.functions import codes

MM_PER_INCH = 25.4


def no_nan(c: Column) -> Column:
    """NULL for NaN."""
    return F.when(~F.isnan(c), c)


def pmin(*cols: Column) -> Column:
    """Least of the columns, NULL if one is."""
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), F.least(*cols))


def pmax(*cols: Column) -> Column:
    """Greatest of the columns, NULL if one is."""
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), F.greatest(*cols))


def ramp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    """0 at lo, 1 at hi, linear between (falling if hi < lo), clipped; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo))))


def season_score(doy: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Trapezoid over the day of the year: 0 up to a, 1 from b to c, 0 from d on."""
    return (
        F.when((doy <= a) | (doy >= d), 0.0)
        .when(doy < b, (doy - a) / (b - a))
        .when(doy <= c, 1.0)
        .otherwise((d - doy) / (d - c))
    )


def season_phase(doy: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the day lies in the season, in words."""
    return F.when((doy <= a) | (doy >= d), "out of season").when(doy < b, "season just starting").when(doy <= c, "in season").otherwise("season winding down")


def phase_now(phase: Column, frost_free: Column, tmin7: Column, full_at: Column) -> Column:
    """The phase, unless frost has ended the season on half of the canopy or nights are warmer than full credit needs."""
    warm = F.concat(F.lit("waiting for cooler nights (7-day mean low "), F.format_string("%.0f", tmin7), F.lit(" C, full credit at "), F.format_string("%.0f", full_at), F.lit(" C)"))
    return F.when(phase == "out of season", phase).when(frost_free < 0.5, "season ended by frost").when(full_at.isNotNull() & (tmin7 > full_at), warm).otherwise(phase)


def pet_climatology(doy: Column) -> Column:
    """Potential evapotranspiration in mm a day from the day of the year alone."""
    return F.lit(2.35) + F.lit(2.05) * F.cos(F.lit(2.0) * F.pi() * (doy - 196) / 365.25)


def extraterrestrial_radiation(doy: Column, latitude: float = 41.7) -> Column:
    """Ra in MJ per square metre and day (FAO-56)."""
    phi = F.radians(F.lit(latitude))
    angle = F.lit(2.0) * F.pi() * doy / 365.0
    dr, delta = F.lit(1.0) + F.lit(0.033) * F.cos(angle), F.lit(0.409) * F.sin(angle - 1.39)
    ws = F.acos(-F.tan(phi) * F.tan(delta))
    return F.lit(24 * 60 * 0.0820) / F.pi() * dr * (ws * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(ws))


def hargreaves(tmax: Column, tmin: Column, doy: Column, latitude: float = 41.7) -> Column:
    """Hargreaves evapotranspiration in mm a day, at least 0."""
    mean = (tmax + tmin) / 2
    span = F.sqrt(pmax(tmax - tmin, F.lit(0.0)))
    return pmax(F.lit(0.0023 * 0.408) * extraterrestrial_radiation(doy, latitude) * (mean + 17.8) * span, F.lit(0.0))


def ndvi(nir: Column, red: Column, least: float = 0.05) -> Column:
    """Normalised difference, NULL where the denominator is at most ``least``, clipped to -1 and 1."""
    total = nir + red
    return F.when(total > least, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (nir - red) / total)))


def decid_index(summer: Column, leaf_off: Column) -> Column:
    return summer - leaf_off


def valid_reflectance(dn: Column, scene_class: Column, keep: tuple[int, ...] = (4, 5, 7)) -> Column:
    """Digital number as reflectance, where the scene class is kept and the number is above 0."""
    return F.when(scene_class.isin(*keep) & (dn > 0), dn * 1e-4)


def canopy_gate(index: Column, summer: Column, marsh: Column, gate: float = 0.80) -> Column:
    """The index where the summer value is above the gate and the cell is no marsh."""
    return F.when(index.isNotNull() & summer.isNotNull() & (summer > gate) & (F.coalesce(marsh, F.lit(0)) != 1), index)


def frost_gate(season: Column, days_since_frost: Column, doy: Column, first_doy: int = 244) -> Column:
    """Season score, 0 if there was a frost since day first_doy of the year."""
    return F.when(F.coalesce(days_since_frost, F.lit(9999)) <= doy - first_doy, 0.0).otherwise(season)


def cool_nights(tmin7: Column, none_at: Column, full_at: Column) -> Column:
    """1 where nights are as cool as full_at, 0 at none_at; 1 for species without the need and where the temperature is missing."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (none_at - tmin7) / (none_at - full_at)))
    return F.when(none_at.isNull() | tmin7.isNull(), 1.0).otherwise(r)


def limiter(*terms: Column) -> Column:
    """1-based place of the least term, the first of equals; of a missing one if there is."""
    spot = F.lit(None).cast("int")
    least = F.least(*terms)
    for k in range(len(terms), 0, -1):
        spot = F.when(terms[k - 1] == least, k).otherwise(spot)
    for k in range(len(terms), 0, -1):
        spot = F.when(terms[k - 1].isNull(), k).otherwise(spot)
    return spot


def score_class(score: Column, canopy: Column, strict: bool = False) -> Column:
    """3 from 0.60, 2 from 0.35, else 1; 0 off the canopy. A missing score on canopy is 1, or NULL if strict."""
    on = F.when(score >= 0.60, 3).when(score >= 0.35, 2).when(score.isNull() & F.lit(strict), F.lit(None).cast("int")).otherwise(1)
    return F.when(canopy, on).otherwise(0)


def rate_to_mm(rate: Column, seconds: int) -> Column:
    """Depth of a rate in mm a second over a step."""
    return rate * seconds


def mm_to_in(mm: Column) -> Column:
    return mm / MM_PER_INCH


def depth_in(depth: Column, units: Column) -> Column:
    """Depth in mm by the unit that the store states: a rate of an hour, or mm."""
    return F.when(units.isin("mm s-1", "mm/s", "kg m-2 s-1"), depth * 3600).otherwise(depth)


def capacity_mm(awc100: Column, awc25: Column, fallback: float = 0.30, least: float = 8.0) -> Column:
    """Water capacity of the root zone in mm from cm; without the 25 cm figure a share of the 100 cm one; at least ``least``."""
    mm = F.coalesce(awc25 * 10, awc100 * 10 * fallback)
    return pmax(mm, F.lit(least))


def volume_m3(depth_mm: Column, area_m2: Column) -> Column:
    return depth_mm / 1000 * area_m2


def flux_m3s(volume: Column, hours: Column) -> Column:
    return F.try_divide(volume, hours * 3600)


def round_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def twin_byte(x: Column, lo: float, hi: float) -> Column:
    """1 to 255 over lo to hi, 0 for missing."""
    return F.coalesce((1 + F.bround(254 * ramp(x, lo, hi))).cast("int"), F.lit(0))


def map_byte(x: Column, lo: float, hi: float) -> Column:
    """0 to 255 over lo to hi; missing is 0 as well."""
    return F.coalesce(F.bround(255 * ramp(x, lo, hi)).cast("int"), F.lit(0))


def palette_index(x: Column, lo: float, hi: float, levels: int) -> Column:
    """1 to levels, 0 for missing."""
    return F.coalesce((1 + F.bround(ramp(x, lo, hi) * (levels - 1))).cast("int"), F.lit(0))


def from_twin(b: Column, lo: float, hi: float) -> Column:
    return F.when(b > 0, lo + (b - 1) / 254.0 * (hi - lo))


def block_id(x: Column, y: Column, side: int = 5000) -> Column:
    """Number of the square block of a projected coordinate."""
    return F.floor(x / side) * 100000 + F.floor(y / side)


def land_code(public_hit: Column, inside: Column) -> Column:
    """2 public, 1 not public, 0 outside."""
    return F.when(inside, F.when(public_hit, 2).otherwise(1)).otherwise(0)


def embedding_valid(e: Column) -> Column:
    """The first number is finite and not all are 0."""
    first = F.get(e, F.lit(0)).cast("double")
    return F.coalesce(~F.isnan(first) & (F.abs(first) != float("inf")), F.lit(False)) & F.exists(e, lambda v: v != 0)


def like_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.like(p) for p in patterns])


def code_label(code: Column, labels: dict, default: str = "unmapped") -> Column:
    """Label of a code, or the default with the code."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.concat(F.lit(f"{default} "), code.cast("string")))


def series_key(*parts: Column) -> Column:
    """Parts joined by '_', NULL if one is."""
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("_", *parts))


def stretch(x: Column, p2: Column, p98: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - p2, p98 - p2)))


def public_owner(name: Column) -> Column:
    """The owner's name matches one of the public patterns."""
    return like_any(name, codes.PUBLIC_OWNERS)


def drainage_ordinal(name: Column) -> Column:
    """1 (dry) to 7 (wet); NULL for other names."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.DRAINAGE.items() for x in kv]), name)


def forest_group(code: Column) -> Column:
    return code_label(code, codes.FOREST_TYPE_GROUPS)
