"""Operators for training-data corpora: sharding, deduplication, decontamination,
language identification, mixing, token files and URL filtering.

Nothing else in the library imports this subpackage. Its functions are pickled by
value, so executors need no copy of the package on their Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
