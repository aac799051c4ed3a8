"""kestrel: count-based and margin-based classification on Spark DataFrames.

Sub-packages
------------
sources    scans / sinks (nominal text, svmlight, model tables, driver views)
functions  Column-expression helpers (md5 ordering, radix codes, kernels, estimators)
operators  DataFrame -> DataFrame operators (structures, counts, scoring, prep, folds, SVM)
plans      the query catalogue used by ``__spark_entry__`` and the DuckDB oracle SQL
streaming  incremental count maintenance with Structured Streaming
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Arrow batch functions are closures over this package; pickle them by value so
    executors need no installed copy of it (the package is not on their path)."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - pyspark missing or an older cloudpickle
        pass


_ship_by_value()
