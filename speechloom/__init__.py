"""speechloom: Spark-first analytics for speech segments and spoken multiple-choice data.

The package's functions travel to Python workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
