"""Stage tables whose heights have ties."""

import pytest

from rillflow.operators import sequence

COLUMNS = ("hand", "area", "length", "bankfull", "channel_width")


@pytest.mark.parametrize("tied", ["area", "length"])
def test_stages_of_one_height_have_one_order(spark, tied):
    """Whatever order the rows come in, and with a null height and rows equal in all."""
    own = lambda a: (a, 50.0) if tied == "area" else (600.0, a / 10)
    rows = [(k, h, *own(a), 2.0, 9.0) for k in range(3) for h, areas in ((1.5, (700.0, 100.0, 400.0)), (2.5, (300.0, 300.0, 200.0)), (None, (500.0, 200.0))) for a in areas]

    def table(order):
        df = spark.createDataFrame(order, "k int, hand double, area double, length double, bankfull double, channel_width double").coalesce(1)
        return sorted(map(tuple, sequence.stage_table(df, ["k"], *COLUMNS).collect()), key=str)

    want = table(rows)
    assert [r[3] for r in want if r[0] == 0 and r[1] in (3, 4)] == ([4.0, 6.0] if tied == "area" else [600.0 / 20, 600.0 / 30])
    assert table(rows[::-1]) == table(sorted(rows, key=lambda r: (-r[2], r[3]) if tied == "area" else (r[2], -r[3]))) == want
