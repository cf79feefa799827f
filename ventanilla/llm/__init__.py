"""Training-data operators (text, embeddings, urls) and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
