"""Document analytics on Spark DataFrames: ingest, segmentation, glossary matching, request planning, merging and alignment."""
