"""DataFrame operators for studying how electoral outcomes relate to public credit."""
