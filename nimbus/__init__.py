"""nimbus: Spark-native analytics for daily station observations.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark's own
column functions, so Catalyst can push filters and prune columns down to the
scan and AQE can re-plan shuffles at run time.
"""

from nimbus.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
