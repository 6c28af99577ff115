"""Training-data pipeline operators (WARC, language models, dedup, decontamination, mixing).

Nothing else in the library imports this package; ``queries.py`` holds the registered
queries and their SQL, ``corpus_pipeline.py`` at the repository top chains the stages.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the task, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
