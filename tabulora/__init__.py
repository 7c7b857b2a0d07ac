"""tabulora: a document-analytics engine on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get the package's functions by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
