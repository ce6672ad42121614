"""Columns that are built once."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def kept(build: Callable) -> Callable:
    """``build`` for hashable arguments, its result kept as long as the JVM lives that holds it.

    A cascade of rules is thousands of calls to the JVM, which take seconds; a Column names no table, so it
    serves every query that has columns of these names.
    """
    held: list = [None, {}]

    @wraps(build)
    def run(*args):
        gateway = SparkContext._gateway
        if held[0] is not gateway:
            held[:] = [gateway, {}]
        if args not in held[1]:
            held[1][args] = build(*args)
        return held[1][args]

    return run
