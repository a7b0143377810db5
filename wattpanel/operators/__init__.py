from . import clean, geo, lags, windows  # noqa: F401
