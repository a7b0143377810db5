from . import holidays, rowstats, scalars  # noqa: F401
