"""Brute-force statements of the contracts, in plain Python."""

import re

SPACE = "[\x20\x09-\x0d]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def docs(spark, rows, extra=""):
    """documents rows (doc_id, text, lang, source, n_chars)."""
    full = [(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def simple(spark, pairs):
    return docs(spark, [(i, t, "en", f"s{i % 3}" if i is not None else None) for i, t in pairs])


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
