"""Spark-native analytics for multi-channel signals recovered from scanned pages."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so that a cluster needs no
# installation and a session started from another folder still finds them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
