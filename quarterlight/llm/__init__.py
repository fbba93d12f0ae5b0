"""Training-data operators: sharding, quality, de-duplication, search, tokens, scoring, mixing.

The functions that run inside tasks travel by value, so that executors need no
copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
