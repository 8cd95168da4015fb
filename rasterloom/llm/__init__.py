"""Operators for training data: vectors, similarity clusters, packing, leakage and repetition."""
