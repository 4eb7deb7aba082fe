"""Cross-view consistency checks of hardware design collateral on Spark.

Functions travel to the executors by value, so a cluster needs the third-party libraries there but not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
