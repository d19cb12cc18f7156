"""Evaluation analytics for retrieval-augmented generation on Spark.

Every operator takes DataFrames and returns a DataFrame; see the sub-packages
``sources``, ``functions``, ``operators``, ``plans`` and ``streaming``.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
