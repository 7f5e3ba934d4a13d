"""lodestone: retrieval, citation-audit and corpus-preparation operators on PySpark.

Every public operator maps DataFrames to a DataFrame; nothing is collected on
the driver.  ``lodestone.llm`` holds the text-corpus operators and is optional:
no other module imports it.
"""

__version__ = "0.1.0"

from pyspark import cloudpickle as _pickle

# Functions that run inside tasks travel with the job, so that the workers need
# no copy of the package on their path.
_pickle.register_pickle_by_value(__import__(__name__))
