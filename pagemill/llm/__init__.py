"""Operators for preparing training text. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Code that runs on executors is sent along with each task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
