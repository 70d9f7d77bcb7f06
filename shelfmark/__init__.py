"""Organise large corpora of files and documents with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from . import constants, functions, operators, plans, runtime, sources  # noqa: E402, F401

__version__ = "0.1.0"
