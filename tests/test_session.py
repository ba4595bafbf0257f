"""A session that starts without spark.checkpoint.dir (in a process of its own)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
from nimbus.session import build_session, scratch_dir
from nimbus.plans import catalog
spark = build_session("local[2]", shuffle_partitions=2)
assert not spark.conf.get("spark.checkpoint.dir", None)
assert scratch_dir(spark) == scratch_dir(spark)
print("ROWS", catalog.QUERIES["trends"](spark, "/root/testdata/sf0.001").count())
"""


def test_trends_without_a_checkpoint_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout and int(done.stdout.split("ROWS")[1]) > 0, done.stderr[-2000:]


def test_the_package_is_shipped_once(spark):
    from nimbus import session

    session.ship_package(spark)
    assert [f for f in spark.sparkContext.listFiles if f.endswith("/nimbus.zip")] == [f for f in spark.sparkContext.listFiles if "nimbus" in f]
    assert len([f for f in spark.sparkContext.listFiles if f.endswith("/nimbus.zip")]) == 1
    session.release_driver(spark)
    assert spark.range(3).count() == 3


def test_a_release_trims_the_native_heap(spark):
    from nimbus import session

    assert session._trim_native_heap(spark) is True
