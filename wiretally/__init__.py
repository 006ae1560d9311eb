"""Spark jobs that turn tables of HTTP exchanges, web pages and API specs into analysed tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python helpers travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
