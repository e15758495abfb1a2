"""cartwalk: session-based recommendation analytics on Spark.

Every operator takes and returns DataFrames; the heavy lifting is joins,
grouped aggregation and windows planned by Catalyst.  Subpackages:

* ``sources``   – table access, the fixture roles, bundles and model artefacts
* ``functions`` – column-expression helpers (rounding, tokens, stemming)
* ``operators`` – profiling, enrichment, imputation, text, interactions,
                  the random-walk model, ranking and evaluation metrics
* ``plans``     – end-to-end compositions and the query registry
* ``streaming`` – Structured Streaming versions of the session operators
"""

from cartwalk.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
