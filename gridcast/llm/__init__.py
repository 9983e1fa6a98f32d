"""Training-data operators: ten operators over `documents`, `embeddings` and `pages`.

Nothing outside this package imports it. ``queries`` holds the registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
