"""sylvan: tree, graph, text and relational analytics as Spark DataFrame plans."""
