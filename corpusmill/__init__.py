"""corpusmill: source and text corpora as Spark tables."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from corpusmill.options import Options  # noqa: E402

__all__ = ["Options"]
