"""Temperature and rain categories, temperature range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def temp_range(tmax: Column, tmin: Column) -> Column:
    return tmax - tmin


# Fixed values: (label, upper limit) in rising order and the label beyond them.
TEMPERATURE_BELOW = [("Freezing", 0), ("Cold", 10), ("Mild", 20), ("Warm", 30)]
HOTTEST = "Hot"
RAIN_UP_TO = [("Light", 2), ("Moderate", 10), ("Heavy", 50)]
DRY, WETTEST = "No Rain", "Extreme"


def _first_limit(limits: list[tuple[str, float]], reached, beyond: str) -> Column:
    """Label of the first limit for which ``reached`` holds, else ``beyond``."""
    label = F.lit(beyond)
    for name, limit in reversed(limits):
        label = F.when(reached(limit), F.lit(name)).otherwise(label)
    return label


def temp_category(tavg: Column, null_label: str = HOTTEST) -> Column:
    """Category of a temperature; a null one gets ``null_label``."""
    label = _first_limit(TEMPERATURE_BELOW, lambda limit: tavg < limit, HOTTEST)
    return F.when(tavg.isNull(), F.lit(null_label)).otherwise(label)


def rain_category(prcp: Column, null_label: str = WETTEST) -> Column:
    """Category of a rain amount; no amount gets ``null_label``, an impossible
    (negative) one the label beyond all limits."""
    wet = _first_limit(RAIN_UP_TO, lambda limit: prcp <= limit, WETTEST)
    known = F.when(prcp == 0, F.lit(DRY)).when(prcp < 0, F.lit(WETTEST)).otherwise(wet)
    return F.when(prcp.isNull(), F.lit(null_label)).otherwise(known)
