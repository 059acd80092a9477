"""The registered queries: the library's operators over the driver's tables."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
