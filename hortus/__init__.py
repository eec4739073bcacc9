"""hortus: wholesale order analytics on PySpark.

The per-partition functions (the ledger and pack folds, the streaming
processor) run in Python workers.  The package is registered with PySpark's
cloudpickle to be shipped by value, so executors need no copy of it installed
(``--py-files`` is not required, and the working folder does not matter).
"""

import sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])
