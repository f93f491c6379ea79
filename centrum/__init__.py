"""Multi-center tabular learning as Spark jobs: every operator takes and returns DataFrames."""
