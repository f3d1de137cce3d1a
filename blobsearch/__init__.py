"""A PySpark-native engine for searching and governing catalogs of media blobs."""

import sys

from pyspark import cloudpickle

# Task functions and data sources travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
