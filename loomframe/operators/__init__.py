"""Operators: DataFrame in, DataFrame out; order-dependent ones take an explicit order column."""
