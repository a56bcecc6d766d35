"""DataFrame -> DataFrame operators (filters, masks, derivations, splits, thinning, scoring, reports)."""
