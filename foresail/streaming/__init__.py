"""foresail.streaming."""
