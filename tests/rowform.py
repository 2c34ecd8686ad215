"""Rows in one form, to compare results of two engines."""


def normal(frame):
    """Rows of a pandas frame in one form, columns by name, sorted."""
    import numbers

    import pandas as pd

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, numbers.Integral):
            return int(v)
        if isinstance(v, numbers.Number) or type(v).__name__ == "Decimal":
            return round(float(v), 6)
        return str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(one, r)) for r in frame.itertuples(index=False)), key=str)
