"""codeloom: code and text retrieval as Spark DataFrame jobs.

Every public operator takes and returns a DataFrame; see README.md for the map
from pipeline step to module.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
