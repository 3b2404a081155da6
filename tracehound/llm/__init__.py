"""Operators for training-data preparation at corpus scale.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its
queries when it is present.  Functions that run in Python workers are pickled by value,
so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
