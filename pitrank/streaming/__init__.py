"""Streams of publications."""

import sys

from pyspark import cloudpickle

# State machines travel to the executors by value, so that a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
