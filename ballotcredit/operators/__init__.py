"""DataFrame operators: joins, rows, loans, votes, donors, coalitions, margins, panels, RD."""
