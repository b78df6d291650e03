"""Table operators: ordering, quantiles, summaries, profiling, bands, grids."""
