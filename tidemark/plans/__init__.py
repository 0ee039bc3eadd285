"""Reports: compositions of operators, each for all products at once."""
