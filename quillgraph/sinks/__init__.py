"""Writers for stages, the graph document and the per-entity documents."""
