"""A PySpark-native engine that turns page text and tables into entities, links, triples and scores."""
