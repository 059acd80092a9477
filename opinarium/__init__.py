"""Review analytics and sentiment-ranked retrieval as Spark DataFrame operators.

Functions that run inside Python workers are shipped by value, so a job needs no
``--py-files`` and no installation on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
