"""Evidence-first claim engine on Spark: claims with scope and provenance, stored as tables and answered in one plan."""
