"""Operators for building training data from text corpora, one module each.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so the package needs no installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
