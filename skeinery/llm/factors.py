"""Suffix-array dedup: later copies go, the first stays.

``repeats`` deals the stretches of text that may recur to groups.  A group's suffixes
(equal stretches count once, with their first place) are put in order with their common prefixes; from the previous and the next smaller
position in that order comes the longest-previous-factor array, the longest match
that each suffix has at an earlier position.  Bytes covered by a factor of
``length`` bytes or more are removed.  Every suffix that starts a window is there, so
order is kept to the first power of two that reaches ``length``: longer factors are
covered by those that start inside them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import without
from .rolling import Texts, ranges
from .suffixes import Order, distinct, previous_factors


def factors(length: int):
    """Which windows have a previous factor of ``length`` bytes or more."""

    def run(n: np.ndarray, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        size = n + length - 1
        ends = np.cumsum(size)
        lead, _ = distinct(data, ends, first)
        own = lead == np.arange(len(n))
        out = np.repeat(~own, n)  # an equal segment stands earlier
        x = np.flatnonzero(own)
        data, m = data[ranges(ends[x] - size[x], size[x])], n[x]
        heads = np.cumsum(size[x]) - size[x]
        order = Order(data, np.repeat(heads + size[x], size[x]) - np.arange(len(data)), length)
        by, common = order.sort(ranges(heads, m))
        del order
        position = (np.repeat(first[x], m) + ranges(np.zeros(len(m), np.int64), m))[by]
        windows = np.flatnonzero(np.repeat(own, n))
        out[windows[by]] = previous_factors(position, common, length) >= length
        return out

    return run


def _finish(t: Texts, gone: np.ndarray) -> dict:
    up = np.append(0, np.cumsum(gone))
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    heads = t.off[:-1][np.diff(t.off) > 0]
    first[heads] = gone[heads]
    n_first = np.append(0, np.cumsum(first))
    kept = t.data[~gone].tobytes()
    at = t.off - up[t.off]
    return {
        "n_bytes": np.diff(t.off).astype(np.int64),
        "n_removed": np.diff(up[t.off]).astype(np.int64),
        "n_spans": np.diff(n_first[t.off]).astype(np.int64),
        "kept": np.array([kept[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] + [None], dtype=object)[:-1],
        "kept_sha256": np.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], dtype=object),
    }


def drop_later_copies(docs: DataFrame, length: int = 100, text: str = "text", key: str = "doc_id", kept: bool = True, **how) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that also starts earlier.

    Earlier: in a document of smaller doc_id, or before it in the same one.  Texts
    are UTF-8 bytes; matches don't cross documents, may overlap, and are judged on
    the input.  Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept binary (left out if kept is false) and kept_sha256, a row for each row of
    docs.  Null texts are empty; other columns are left out; for repeated rows and
    null doc_ids see ``repeats.without``; an empty table gives an empty result.
    """
    schema = "n_bytes long, n_removed long, n_spans long, " + "kept binary, " * kept + "kept_sha256 string"

    def finish(t: Texts, gone: np.ndarray) -> dict:
        out = _finish(t, gone)
        return out if kept else {c: x for c, x in out.items() if c != "kept"}

    rows = docs.selectExpr(f"`{key}` as doc_id", f"`{text}` as text")
    return without(rows, "byte", length, max(1, 3 * length // 10), True, factors(length), finish, schema, **how)
