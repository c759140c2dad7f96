"""Retrieval of past support solutions over ticket graphs, as Spark jobs.

Every public function takes and returns DataFrames. Nothing here holds a session, and no job
runs at import time.
"""

import sys

from pyspark import cloudpickle

from supportgraph.options import HANDLER, PAGE, RETRIEVER, RetrievalOptions

__all__ = ["RetrievalOptions", "RETRIEVER", "HANDLER", "PAGE"]

# Functions that run in tasks travel with the task: executors need numpy and pyarrow, not this
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
