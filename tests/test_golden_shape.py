"""Shape invariants of the published run: 5 cities x 1,057 days
(2023-01-01 .. 2025-11-22) -> 5,285 clean rows, 1,057 daily, 35 monthly and
12 seasonal rows. Hand-made payload documents, flattened by the engine."""

import datetime as dt
import json

from nimbus.operators import aggregate, clean, enrich
from nimbus.plans import batch
from nimbus.sources import payload

CITIES = ["Nice", "Cannes", "Monaco", "Antibes", "Menton"]


def _docs(spark):
    start = dt.date(2023, 1, 1)
    days = [(start + dt.timedelta(days=i)).isoformat() for i in range(1057)]
    docs = []
    for c, city in enumerate(CITIES):
        docs.append(json.dumps({
            "location_name": city,
            "latitude": 43.5 + c / 10,
            "longitude": 7.0 + c / 10,
            "fetch_timestamp": "2025-11-23T00:00:00",
            "data": {"daily": {
                "time": days,
                "temperature_2m_max": [20.0 + (i % 10) for i in range(1057)],
                "temperature_2m_min": [10.0 + (i % 7) for i in range(1057)],
                "temperature_2m_mean": [15.0 + (i % 9) - c for i in range(1057)],
                "precipitation_sum": [float(i % 4) for i in range(1057)],
                "windspeed_10m_max": [5.0 + (i % 3) for i in range(1057)],
                "relative_humidity_2m_mean": [60.0 + (i % 20) for i in range(1057)],
            }},
        }))
    return spark.createDataFrame([(d,) for d in docs], "value string")


def test_published_shape(spark):
    assert days_between() == 1057
    rows = payload.flatten_payload(payload.parse_payloads(_docs(spark)))
    frames = batch.process_all(rows)
    assert frames["raw"].count() == 5285
    assert frames["clean"].count() == 5285
    assert frames["daily"].count() == 1057
    assert frames["monthly"].count() == 35
    assert frames["seasonal"].count() == 12
    assert frames["trends"].count() == 1057
    d = frames["daily"].filter("DATE = DATE'2024-02-29'").first()
    assert d.RECORDS_COUNT == 5 and d.STATION == "OPENMETEO_ANTIBES"


def days_between():
    return (dt.date(2025, 11, 22) - dt.date(2023, 1, 1)).days + 1
