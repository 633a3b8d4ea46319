"""Outdoor geodata analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# batch functions travel to the workers by value, so no installation is needed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
