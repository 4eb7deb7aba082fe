"""Operators that prepare a corpus for training language models.

Nothing outside of this package imports it. Its functions travel to the executors by value, so a cluster
needs the third-party libraries there but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
