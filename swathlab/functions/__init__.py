"""Column expressions: identifiers, dates, pixel and wind arithmetic, masks, raster arrays."""
