"""foresail.plans."""
