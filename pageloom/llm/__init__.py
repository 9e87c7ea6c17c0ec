"""Operators for building training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors need not have the library installed: its code goes with the plans.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
