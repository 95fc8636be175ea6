"""tagwise: multi-label text analytics as Spark DataFrame operators."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of the package travel to the workers by value: executors need no copy of it,
# whatever folder or path the driver was started with.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
