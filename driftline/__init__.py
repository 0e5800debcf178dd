"""driftline: analysis of large occurrence-record collections as Spark jobs.

functions   Column expressions (hash buckets, text, numbers, geometry, p-values)
sources     readers, schema probing, writers
operators   DataFrame -> DataFrame steps
plans       whole jobs and the query catalogue
streaming   incremental ingest
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with them; executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
