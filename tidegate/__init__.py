"""tidegate: stream and batch analytics as Spark DataFrame, SQL and Structured Streaming plans."""

import sys

from pyspark import cloudpickle

# Functions and processors travel to the workers by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
