"""Training-data operators: filters, deduplication, decontamination, mixing, sharding.

Each module holds one operator with its general interface; ``queries`` holds the thin
``opN_<name>`` queries over the given tables. Nothing else in the library imports this
subpackage.
"""

from pyspark import cloudpickle

import tagwise

# Functions of the package travel to the workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(tagwise)
