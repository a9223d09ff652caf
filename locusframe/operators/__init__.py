"""operators of the variant-table library."""
