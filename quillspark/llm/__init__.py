"""Operators that prepare a training corpus: one module for each, DataFrame in, DataFrame out."""
