"""The analyses end to end, built from the operators."""
