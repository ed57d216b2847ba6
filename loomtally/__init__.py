"""loomtally: a PySpark-native engine that measures source trees and text corpora."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
