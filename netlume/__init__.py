"""netlume: labelled network-telemetry preparation and detector benchmarking on Spark."""

import sys

from pyspark import cloudpickle

# Executor functions travel with their code, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
