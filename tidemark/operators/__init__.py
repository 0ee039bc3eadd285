"""DataFrame operators: one concern per module, all products at once."""
