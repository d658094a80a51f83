"""visitlens — Spark-native analytics for yearly field-visit plans and their follow-up.

Every public operator takes and returns Spark DataFrames (or Columns) and is
expressed with DataFrame/SQL primitives, so Catalyst plans it and the work
runs partitioned on the executors.  Sub-packages:

* ``functions`` – Column expressions (text, dates, flags, similarity score)
* ``sources``   – readers, sinks, JSON payloads, SQL registration
* ``operators`` – DataFrame -> DataFrame building blocks (filters, rankings,
                  KPIs, Pareto, similarity join, cell canonicalisation)
* ``plans``     – report compositions and the two-phase label normaliser
* ``streaming`` – incremental ingestion of payload batches
"""

from visitlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
