"""Operators that prepare training text: scans, near-duplicates, filters, tokens, shards.

The functions that run inside tasks are sent by value, so executors need the
third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
