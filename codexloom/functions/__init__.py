"""Part of codexloom."""
