"""Text-corpus token analytics as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the few Python helpers with the task, not by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
