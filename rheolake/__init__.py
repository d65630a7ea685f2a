"""rheolake: Spark-native analytics for time-resolved velocity-field imaging."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in tasks travel with them, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
