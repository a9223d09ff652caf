"""plans of the variant-table library."""
