"""caseweave: case-evidence analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the pickled task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
