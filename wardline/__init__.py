"""Clinical deterioration scoring and alert governance as Spark jobs."""

import sys

try:
    # Step functions travel to the executors by value, so a job runs on a cluster that
    # does not have this package installed.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass

__version__ = "0.1.0"
