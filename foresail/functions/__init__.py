"""foresail.functions."""
