"""Training-data operators. Nothing else in the library imports this package.

Functions of the package travel to the executors by value, so a cluster needs
neither the repository on its workers nor a zip of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
