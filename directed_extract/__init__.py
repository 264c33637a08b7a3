"""directed_extract: directed entity extraction and corpus preparation as DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
