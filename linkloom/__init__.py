"""linkloom — content-graph analytics as Spark DataFrame operators.

Pages -> links -> weighted graph -> centrality -> text features -> clusters
-> pillars -> link recommendations -> report queries.  Every operator is a
function ``f(df, ...) -> DataFrame``; many sites run in one job keyed by a
``site`` column.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so workers need not have this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
