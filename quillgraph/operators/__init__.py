"""The operators: extraction, links, ranking, graph, search and audits."""
