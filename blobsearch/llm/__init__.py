"""Operations of a training-data pipeline, each a function from DataFrames to a DataFrame.

Nothing else in the package imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
