"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from pyspark import cloudpickle

import ledgerlake.llm as _self

# Functions sent to Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(_self)
