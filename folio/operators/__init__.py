"""DataFrame -> DataFrame: filters, projections, listing, counts, archive, contents, lookups and search."""
