"""DataFrame-in, DataFrame-out operators of entity resolution."""
