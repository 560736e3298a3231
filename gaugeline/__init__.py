"""gaugeline: DataFrame operators that check whether a ranking deserves trust.

The package holds plain functions from DataFrames to DataFrames. Functions that
run inside Python workers are pickled by value, so executors need PySpark,
pyarrow and numpy but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
