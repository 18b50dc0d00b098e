"""End-to-end channels built from the operators."""
