"""Helpers that several test modules import."""


def rows(df, *order):
    """Rows as tuples in a stated order."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
