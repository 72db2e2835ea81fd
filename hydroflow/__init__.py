"""hydroflow: DataFrame-to-DataFrame operators over keyed hourly time series on Spark.

Entry points: ``hydroflow.api`` (the reference's function names: prepare_data, prep_rainfall,
run_acf_analysis, feature_ablation_study, ..., run_experiments), the operator modules in
``hydroflow.operators`` (blocked windows, scan, resample, splits, ranking, metrics, profile,
statistics, models), ``hydroflow.sources`` / ``hydroflow.streaming`` for I/O, and
``hydroflow.plans.queries`` for the registered queries with their DuckDB oracle SQL.
"""

__version__ = "0.1.0"
