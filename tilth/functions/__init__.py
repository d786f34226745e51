"""Column expressions: spectral indices, agronomy, geodesy, statistics, text."""
