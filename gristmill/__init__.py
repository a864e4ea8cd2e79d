"""Dataset preparation and judging as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from gristmill.session import build_session

# Helpers that run in Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
