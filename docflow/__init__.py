"""docflow: document-page processing as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the package's Python functions inside the task closure, so executors
# need no copy of the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
