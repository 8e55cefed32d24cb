"""Query catalogue, oracles and pipelines built from the operators."""
