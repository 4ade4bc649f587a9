"""Column-level building blocks: everything here returns a Catalyst expression."""
