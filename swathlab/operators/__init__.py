"""DataFrame operators: selection, joins, aggregates, windows, plumes, curves, sampling, geometry, physics."""
