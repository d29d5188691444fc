"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Functions of it are sent
to the executors by value, so that a cluster needs no copy of the library in
its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
