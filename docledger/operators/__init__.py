"""DataFrame-to-DataFrame steps of the invoice workflow."""
