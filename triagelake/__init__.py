"""triagelake: incident corpus, similarity search and triage as Spark jobs."""

import sys as _sys

from pyspark import cloudpickle as _cp

# ship this package's functions by value to Python workers
_cp.register_pickle_by_value(_sys.modules[__name__])
