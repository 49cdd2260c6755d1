"""Python tasks find the package wherever the driver was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from trackweave.session import get_session
from trackweave.operators.neighbours import nearest
spark = get_session("shipping", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "track_id int, vector array<double>")
print("rows", nearest(items.withColumnRenamed("track_id", "query_id"), items, 1).count())
"""


def test_other_working_directory(tmp_path):
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT)],
        cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=180,
    )
    assert "rows 2" in done.stdout, done.stderr[-2000:]
