"""Label and reference-data quality work as Spark DataFrame functions.

The functions that run on executors are sent by value, so a cluster needs this
package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
