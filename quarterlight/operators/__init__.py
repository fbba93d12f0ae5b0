"""DataFrame operators. The functions that run inside tasks travel by value, so executors need no copy of this package on their path."""

import sys

from pyspark import cloudpickle

from .. import functions

for _module in (sys.modules[__name__], functions):
    cloudpickle.register_pickle_by_value(_module)
