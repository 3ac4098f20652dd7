"""Chains of operators that belong together, as one lazy plan."""
