"""Encyclopedia dump to knowledge graph, as Spark DataFrame functions."""
