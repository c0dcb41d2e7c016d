"""Compiler-shaped documents made of the plain tables, so that queries can run the tree, graph, IR and SQL operators
over whole tables and SQL can say what they must give. No part of the engine needs them."""
