"""sources of the variant-table library."""
