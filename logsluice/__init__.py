"""Log triage as Spark DataFrame, SQL and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers carry their code with them, so a job needs no package
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
