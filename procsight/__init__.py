"""Process-quality analytics expressed as Spark jobs.

A measurement table has one row per produced item: a key, numeric measurements
named by a common prefix, and (for labelled data) a rare 0/1 outcome.
"""

import sys

from pyspark import cloudpickle

KEY = "CoilID"
LABEL = "Y"
PREFIX = "X"

# The few functions that run in Python workers travel with the plan, so a cluster
# needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
