"""wavelens: preparing and scoring transcribed-speech corpora on Spark.

Functions handed to Python workers (``mapInPandas``) are pickled by value,
so executors need no copy of this package on their path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
