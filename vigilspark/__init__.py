"""Condition-monitoring analytics over run-to-failure series, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task helpers travel with the job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
