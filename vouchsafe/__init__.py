"""Vouchsafe: a dataset governance library on Spark DataFrames and Structured Streaming.

A batch of records becomes an immutable dataset version. The version is
validated against a contract, enriched, embedded and judged by quality gates;
it is then published or refused through an append-only ledger.
"""

import sys

from pyspark import cloudpickle

# Ship the small Arrow helpers by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
