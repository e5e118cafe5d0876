"""Training-data operators: one module an operator, `queries` ties them to the tables."""
