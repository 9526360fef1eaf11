"""Crawl analytics and page search as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so that executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
