"""kvist: a Spark-first engine for retrieval, evaluation and corpus preparation over regulatory text.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (Column functions), ``operators``
(DataFrame -> DataFrame), ``plans`` (query catalogue, oracles, pipeline), ``streaming``. The
optional sub-package ``llm`` holds operators for training data; nothing outside it imports it.
"""

__version__ = "0.1.0"
