"""Nothing here: the model has no streams.  Flow tables that grow are re-aggregated by batch queries."""
