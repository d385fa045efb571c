"""Part of the data-contract engine."""
