"""Two-source reconciliation on Spark DataFrames: matching, orphans, evidence, recipes and reports."""
