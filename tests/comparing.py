"""Helpers that several test files import; a module of its own, since every folder may have a conftest."""


def rows(df, *columns):
    shown = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in shown.collect()), key=repr)
