"""Operators: DataFrame to DataFrame, without knowledge of the registered queries."""
