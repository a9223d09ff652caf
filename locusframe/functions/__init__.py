"""functions of the variant-table library."""
