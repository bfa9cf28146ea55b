"""Queries over the star-schema, event and document tables, registered with their SQL."""

from . import cells, contracts, events, forecasts, joins, judged, kernels, linkage, merges, periods, products, records, reports, series, shares, slot_files, texts  # noqa: F401
