"""Spark library for auditing content-category verdicts on advertising media."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their code, so the
# package has to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
