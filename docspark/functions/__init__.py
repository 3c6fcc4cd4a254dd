"""Part of docspark."""
