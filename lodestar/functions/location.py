"""Short location codes: grid codes of base twenty, made whole again near a known place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import haversine_km

#: The digits of the code, in order (fixed values).
DIGITS = "23456789CFGHJMPQRVWX"
#: A pair of digits divides a degree cell by twenty each way; five pairs in all.
_STEPS = 8000


def encode(lat: Column, lng: Column, pairs: int = 5) -> Column:
    """The first ``pairs`` digit pairs of a place's code, without the plus sign."""
    y, x = F.floor((lat + 90) * _STEPS), F.floor((lng + 180) * _STEPS)
    digit = lambda n, k: F.substr(F.lit(DIGITS), (F.floor(n / 20 ** (4 - k)) % 20 + 1).cast("int"), F.lit(1))
    return F.concat(*(digit(n, k) for k in range(pairs) for n in (y, x)))


def decode_short(code: Column, lat0: Column, lng0: Column, box: tuple[float, float, float, float], most_km: float) -> Column:
    """struct(lat, lng, fault) of a short code (``XXXX+XX``) near a place.

    The missing pairs are the place's own; the cell moves by one degree where another is nearer.  Refused, with
    a reason and no coordinates: malformed codes, places outside ``box`` (south, north, west, east), and places
    farther than ``most_km``.
    """
    plain = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    good = plain.rlike(f"^[{DIGITS}]{{4}}\\+[{DIGITS}]{{2}}$")
    at = {k: F.position(F.substr(plain, F.lit(k), F.lit(1)), F.lit(DIGITS)) - 1 for k in (1, 2, 3, 4, 6, 7)}
    part = lambda a, b, c: ((at[a] * 20 + at[b]) * 20 + at[c] + 0.5) / _STEPS

    def whole(near: Column, inside: Column) -> Column:
        value = F.floor(near) + inside
        return F.when(near + 0.5 < value, value - 1).when(near - 0.5 > value, value + 1).otherwise(value)

    lat, lng = F.round(whole(lat0, part(1, 3, 6)), 7), F.round(whole(lng0, part(2, 4, 7)), 7)
    outside = ~(lat.between(box[0], box[1]) & lng.between(box[2], box[3]))
    fault = F.when(~good, "malformed").when(outside, "outside").when(haversine_km(lat0, lng0, lat, lng) > most_km, "far")
    return F.struct(F.when(fault.isNull(), lat).alias("lat"), F.when(fault.isNull(), lng).alias("lng"), fault.alias("fault"))
