"""tagstream: detection, tag-reading and label tables on Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to executors inside the tasks, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
