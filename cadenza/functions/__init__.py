"""Column expressions of the model: time, Fourier terms, trends, random numbers, metrics."""
