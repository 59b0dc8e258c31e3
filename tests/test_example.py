from datetime import timedelta

from examples import trip_report
from tests.trips import TEN, table, trip
from tripkit import operators as op


def test_the_whole_report_runs(spark, tmp_path):
    paths = []
    for month in range(2):
        path = str(tmp_path / f"month={month}")
        rows = [
            trip(
                start=TEN + timedelta(days=31 * month, minutes=97 * i),
                minutes=2 + i % 50,
                party=1 + i % 7,
                distance=0.5 + i % 30,
                fare=3 + 2.5 * (i % 30),
                place=i % 12,
            )
            for i in range(300)
        ]
        table(spark, *rows).write.parquet(path)
        paths.append(path)
    out = tmp_path / "reports"
    trip_report.run(
        spark,
        paths,
        trip_report.writer(str(out)),
        op.ForestSpec(trees=4, depth=4),
        op.BoostSpec(iterations=2, depth=3),
    )
    seen = {path.name: spark.read.parquet(str(path)) for path in out.iterdir()}
    assert all(len({c.lower() for c in df.columns}) == len(df.columns) for df in seen.values())
    profile = {(r["section"], r["name"]): r["n"] for r in seen["profile"].collect()}
    assert profile["table", "rows"] == 600 and profile["table", "kept"] == 600 - 84
    assert ("measure", "fare_amount") in profile and ("measure", "PULocationID") not in profile
    assert seen["both_APIs_agree"].first()["differing"] == 0
    assert {row["model"] for row in seen["models"].collect()} == {"forest", "gbt"}
    assert seen["revenue_and_volume"].count() == 12
    assert seen["fare_by_place"].count() == 12
