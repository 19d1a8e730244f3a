"""Spark jobs that build, analyse and audit labelled corpora of threaded discussions."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
