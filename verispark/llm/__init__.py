"""Operators for building training corpora: filters, de-duplication, decontamination, packing.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
