"""glossvec: dictionary, vocabulary and embedding-table analytics on Spark.

Every operator takes DataFrames and returns a DataFrame. Nothing here keeps a
global session; the session is taken from the inputs.
"""

import sys

from pyspark import cloudpickle

# Ship the package's functions with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
