"""The averages over files that keep arriving."""
