import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from shelfmark.runtime import build_session
from shelfmark.operators.vectors import l2_normalize
spark = build_session("away", "local[1]", spark__ui__enabled="false")
print([r.vec for r in l2_normalize(spark.createDataFrame([([3.0, 4.0],)], "vec array<double>")).collect()])
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Started from another folder, Python workers cannot import the package."""
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "[[0.6, 0.8]]" in run.stdout, run.stderr[-2000:]
