"""masswright: semi-discrete optimal transport on Spark DataFrames."""
