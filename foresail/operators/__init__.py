"""foresail.operators."""
