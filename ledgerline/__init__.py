"""Account lifecycle analytics as Spark DataFrame transformations.

Layers, each a set of pure functions from DataFrames to a lazy DataFrame:

* ``sources``    read the five raw tables (CSV/parquet with fixed schemas, or the
                 mapping from the driver's TPC-H style test tables);
* ``operators``  staging, intermediate models, monthly signals and the rule
                 classifiers of the lifecycle mart;
* ``plans``      the mart itself, the reports on top of it, data-quality checks
                 and profiling queries;
* ``streaming``  file-stream ingestion of the two daily sources.

Nothing here collects data to the driver; every function returns a lazy plan.
"""

from ledgerline.rules import Rules

__all__ = ["Rules"]
