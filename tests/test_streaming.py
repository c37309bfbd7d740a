import json
import os

from commsight.streaming.measurements import start_daily_counts
from tests.conftest import rows


def _write(path, name, results):
    with open(os.path.join(path, name), "w") as f:
        f.write(json.dumps({"country": "CA", "test": "whatsapp", "body": json.dumps({"results": results})}) + "\n")


def test_streaming_daily_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    m = lambda day, a: {"probe_cc": "CA", "test_name": "whatsapp",
                        "measurement_start_time": f"2024-01-{day:02d}T12:00:00Z", "anomaly": a}
    _write(src, "a.json", [m(1, True), m(1, False), m(2, False)])
    _write(src, "b.json", [m(2, True), m(6, False)])  # day 6 pushes the watermark past days 1-2
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = start_daily_counts(spark, str(src), out, ck, watermark="1 day", available_now=True)
    q.awaitTermination(120)
    got = rows(spark.read.parquet(out), "day_start", "probe_cc", "anomalies", "accessible")
    # Days 1 and 2 are closed by the watermark (latest event day 6 minus one
    # day) and appended once; day 6 is still open and not emitted.
    assert [(str(d)[:10], cc, a, b) for d, cc, a, b in got] == [
        ("2024-01-01", "CA", 1, 1), ("2024-01-02", "CA", 1, 1)]
