"""Rows of a DataFrame as plain Python values."""


def rows(df):
    """Rows as sorted plain tuples."""

    def plain(v):
        if isinstance(v, list):
            return tuple(plain(x) for x in v)
        if hasattr(v, "asDict"):
            return tuple(plain(x) for x in v)
        return v

    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
