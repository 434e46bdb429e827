"""Small readings of graph results, shared by the tests."""


def multiset(df):
    """Vertices of ``(v, m)`` rows, repeated by multiplicity."""
    return sorted(v for v, m in df.select("v", "m").collect() for _ in range(m))


def pairs(df):
    return sorted((r[0], r[1]) for r in df.select("src", "dst").collect())
