"""Shared by the tests."""


def rows(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
