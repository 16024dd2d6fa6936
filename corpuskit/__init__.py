"""corpuskit: prepare, link, enrich, search and audit chunked document corpora on Spark."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors by value, so a job needs nothing
# installed there beyond PySpark itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
