"""Assessment grading and cohort analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from gradewright.settings import DEFAULTS, Thresholds

# Python functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULTS", "Thresholds"]
