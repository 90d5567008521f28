"""DataFrame-to-DataFrame operators keyed by video."""
