"""shelfwise: retail-sales and short-text analytics expressed as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``
for expression helpers) built from Spark SQL expressions, windows, joins and
MLlib, so Catalyst plans the work and executors run it.

Layout:
  sources/    readers, writers and the fixture views over the shared tables
  functions/  column-expression helpers (number parsing, flags, text cleaning)
  operators/  the DataFrame operators (cleaning, filters, aggregates, series,
              text features, model preparation, models, metrics)
  plans/      composed queries (dashboard tabs, notebooks) and the oracle SQL
  streaming/  the same operators over a file stream
"""

from shelfwise.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
