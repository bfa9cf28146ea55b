"""DataFrame operators: merges, diffs, lookups, top-k, series, cells, events, groups, resampling, guards."""
