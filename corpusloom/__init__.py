"""corpusloom: corpus retrieval, evaluation and training-data operators as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python operators are shipped to executors by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
