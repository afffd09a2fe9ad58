"""Operators for preparing language-model training data.

Functions of this package travel to the executors with the jobs that use them, so only numpy, pyarrow and the like have to
be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
