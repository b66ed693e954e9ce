"""Spark-native survey-record analytics."""

import sys as _sys

__version__ = "0.1.0"

# Python steps (mapInPandas, pandas UDFs) reference functions of this package.
# Pickling the package by value lets executors run them without having the
# package installed or on their path (no files to ship).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package instead
    pass
