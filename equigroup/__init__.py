"""equigroup: feature-dependence analysis, feature grouping, fairness auditing,
attribution and run reporting as Spark DataFrame jobs.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame; nothing is collected to the driver except fitted parameters whose
size is bounded by the schema (category lists, per-column moments).
"""

import sys

from pyspark import cloudpickle

from equigroup.session import get_spark, checkpoint_dir  # noqa: F401

# Functions that run in executors travel with the task, code included, so the
# executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "checkpoint_dir"]
