"""Operators for preparing language-model training data; nothing else in the package imports this folder.

Functions that run inside Python workers are pickled by value, so executors need no copy of this folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
