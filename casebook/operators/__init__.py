"""DataFrame-to-DataFrame operators keyed by inquiry and tenant."""
