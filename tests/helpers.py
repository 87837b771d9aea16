import math


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(cell(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return [tuple(cell(v) for v in r) for r in df.collect()]


def sorted_rows(df, *columns):
    return sorted(rows(df, *columns), key=lambda r: tuple((v is not None, str(v)) for v in r))
