"""sievework: a dataset-curation engine on Spark DataFrames."""
