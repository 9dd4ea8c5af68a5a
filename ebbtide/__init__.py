"""Subscription-churn analytics expressed as Spark DataFrame transforms and Spark ML stages."""

import sys

from pyspark import cloudpickle

# Helper functions travel to the tasks inside their closures: executors need numpy and pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
