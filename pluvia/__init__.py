"""pluvia: rainfall nowcasting analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from pluvia.session import get_session

# Functions that run in Python workers travel with the query, so executors need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
