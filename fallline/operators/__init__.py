"""Operators: DataFrame in, DataFrame out, nothing runs before an action."""
