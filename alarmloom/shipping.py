"""Sends the package's functions to Python workers inside the job itself."""

import sys

from pyspark import cloudpickle

_PACKAGE = sys.modules[__package__]


def ship_by_value() -> None:
    """Pickle functions and classes of this package by value, so that workers need no copy of it."""
    if _PACKAGE.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(_PACKAGE)
