"""What several test modules share. Not in a conftest: another folder's conftest has the same module name."""


def rows(df, *columns):
    """The rows as a set of tuples."""
    picked = df.select(*columns) if columns else df
    return {tuple(r) for r in picked.collect()}
