"""tidemark: event-sourced text and entity data on Spark DataFrames."""
