"""Part of corpusloom; see the README for the map of modules."""
