"""Training-data operators: filters, joins and tokenizers over a documents table.

Nothing outside this package imports it.  Its functions are pickled by value, so executors need no copy of the
library on their own disks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
