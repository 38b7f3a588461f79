"""Rows of two engines as comparable values."""

import math


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or str(v) in ("NaT", "<NA>") or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 9)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=str)
