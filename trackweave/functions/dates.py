"""Column functions over release dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.numeric import flag

# Half-open year ranges, tried in this order.
ERAS = {
    "2020s": (2020, 2030),
    "2010s": (2010, 2019),
    "2000s": (2000, 2009),
    "90s": (1990, 1999),
    "older": (0, 1989),
}


def parse_date(text: Column, formats: Sequence[str] = ("yyyy-MM-dd",)) -> Column:
    """First format that parses, else NULL. Partial dates are opt-in (``yyyy-MM``, ``yyyy``)."""
    return F.coalesce(*[F.try_to_date(text, pattern) for pattern in formats])


def era(year: Column, eras: Mapping[str, tuple[int, int]] = ERAS) -> Column:
    """Name of the half-open range that holds the year, ``unknown`` in the gaps."""
    label = F.when(year.isNull(), F.lit(None).cast("string"))
    for name, (start, end) in eras.items():
        label = label.when((year >= start) & (year < end), F.lit(name))
    return label.otherwise(F.lit("unknown"))


def temporal_features(
    release_date: Column, as_of_year: int, eras: Mapping[str, tuple[int, int]] = ERAS
) -> dict[str, Column]:
    """Calendar parts, decade, era and age of a parsed date."""
    year = F.year(release_date)
    age = F.lit(as_of_year) - year
    return {
        "release_year": year,
        "release_month": F.month(release_date),
        "release_day": F.dayofmonth(release_date),
        "release_decade": F.concat((year - year % 10).cast("string"), F.lit("s")),
        "music_era": era(year, eras),
        "track_age_years": age,
        "is_recent_release": flag(age < 1),
    }
