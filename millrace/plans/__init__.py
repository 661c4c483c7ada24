"""From syntax trees to DataFrames: types, names, expressions, and the order of the clauses."""
