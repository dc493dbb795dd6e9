"""skirmish — PySpark-native analytics for team-versus-team match data.

Every operator is a function over DataFrames built from Spark built-ins:

* ``skirmish.sources``   — table reads (parquet / partitioned JDBC), the class
  dimension, result sinks, landed-payload flatteners, domain tables;
* ``skirmish.functions`` — column functions (scalars, date ranges, class labels);
* ``skirmish.operators`` — filters, joins, reports, ordered/window operators,
  table maintenance, replay parsing;
* ``skirmish.streaming`` — Structured Streaming ingest (``foreachBatch``);
* ``skirmish.plans``     — the registered queries and their SQL oracles.
"""

from skirmish.session import build_session, configure, ensure_checkpoint_dir

__all__ = ["build_session", "configure", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
