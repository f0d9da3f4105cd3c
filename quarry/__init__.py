"""quarry: document-corpus and retrieval analytics expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that the
# executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
