from datetime import datetime, timedelta

import pytest

from stowage.functions.shared import cut
from stowage.operators import flights


def test_both_directions_read_flights_once(spark):
    """Nulls, a flight from an airport to itself, several legs a day and two days; against a plain loop."""
    day = datetime(2024, 1, 1, 6)
    legs = [(1, 3, 5), (1, 5, 3), (2, 3, 3), (3, None, 3), (4, 3, None), (5, None, None), (6, 4, 5), (None, 3, 4), (7, 4, 3), (7, 4, 3)]
    rows = [(n, a, b, day + timedelta(hours=h)) for k, (n, a, b) in enumerate(legs) for h in (0, k % 3, 24)] + [(8, 3, 4, None), (9, 5, 3, day), (9, 3, 6, day + timedelta(hours=1)), (9, 3, 1, day + timedelta(hours=1))]
    table = cut(spark.createDataFrame(rows, "flight_number long, origin int, destination int, departure timestamp_ntz"))
    for direction, sides in (("both", ("departure", "arrival")), ("departure", ("departure",)), ("arrival", ("arrival",))):
        want = {}
        for n, a, b, at in rows:
            for side in sides:
                if (a if side == "departure" else b) == 3:
                    key, place = (n, at and at.date()), (at or day, side != "departure", -1 if b is None else b)
                    if key not in want or place < want[key][0]:
                        want[key] = place, (n, a, b, at, side)
        out = flights.at_airport(table, 3, direction)
        assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        assert out.columns == [*table.columns, "direction"]
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(r) for _, r in want.values())
    with pytest.raises(ValueError, match="unknown direction"):
        flights.at_airport(table, 3, "back")
