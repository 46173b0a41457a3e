"""siltstone: repository and document analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# functions for Python workers are sent by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
