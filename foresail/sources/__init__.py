"""foresail.sources."""
