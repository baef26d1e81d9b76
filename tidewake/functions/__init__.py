"""Part of the tidewake engine."""
