"""Training-data operators: each module is one operator, `queries` registers them.

Functions that run in tasks are pickled by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
