"""ferrule: a Spark-native data-mining engine.

Every operator is a function from DataFrames to DataFrames.  Functions that must
run in Python on the executors travel by value, so that executors need Spark,
Arrow and numpy but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
