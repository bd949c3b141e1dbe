"""Operators for preparing language-model training data.

Functions of this package that run in Python workers travel with the job, so
executors need the third-party packages but not this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
