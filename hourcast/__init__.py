"""hourcast: hourly demand analytics and forecasting on Spark.

Layout:
    sources/    trip CSVs with two header generations, weather / forecast JSON,
                enriched hourly tables, adapters over the driver tables
    functions/  column expressions: calendar, flags, holidays, nulls, losses
    operators/  DataFrame operators: aggregates, positional windows, features,
                sequences, scaling, metrics, analysis, top-k
    plans/      end-to-end jobs: ingest, train / evaluate / score, experiments
    streaming/  incremental hourly counts over a landing folder
"""

__version__ = "0.1.0"
