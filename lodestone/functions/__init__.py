"""Column builders: tokenisers, normalisers, vectors, hashes."""
