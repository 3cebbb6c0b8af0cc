"""KPI movement investigation on Spark.

Every operator is a function from DataFrames to a DataFrame.  Thresholds,
weights and access rules live in :mod:`kpisleuth.config`; operators receive
them as arguments or as small configuration DataFrames.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark.cloudpickle import register_pickle_by_value as _by_value

# Python functions travel to the executors inside their tasks, so the package
# need not be installed there.
_by_value(_sys.modules[__name__])
