"""Send a module's functions to executors with the code they run, so that executors need no copy of this package."""

from __future__ import annotations


def ship(module) -> None:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(module)
