"""Substring dedup by prefix-partitioned suffix trees: every copy of a repeated passage goes.

``repeats`` deals the stretches of text that may recur to groups; equal stretches
recur as they are, and of each one is kept.  There the suffixes are split by prefixes of variable length: by one word, and where more than ``SUBTREE``
suffixes share it by two, four and so on, until the part fits in memory; a suffix
alone under its prefix has no internal node above it.  Each part's suffix tree is
built from the order of its suffixes and their common prefixes.  The leaves below an
internal node of depth ``length`` or more are the places of a maximal repeat, and the
windows that start there go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import without
from .rolling import Texts, ranges
from .suffixes import Order, distinct, nodes

#: Suffixes of a subtree that is built at a time, if their prefix can still be lengthened.
SUBTREE = 1 << 18


def parts(order: Order, at: np.ndarray, length: int, most: int) -> Iterator[np.ndarray]:
    """The suffixes at these places by prefixes of variable length, in parts of about ``most`` suffixes."""
    for h, rank in order.levels:
        r = rank[at]
        by = np.argsort(r, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(r[by]) != 0)) if len(by) else np.zeros(0, np.int64)
        size = np.diff(np.append(cuts, len(by)))
        last = h >= length or h == order.levels[-1][0]
        fits = (size > 1) & ((size <= most) | last)
        # small neighbouring groups are taken together
        small = by[np.repeat(fits, size)]
        ends = np.cumsum(size[fits])
        i = 0
        while i < len(small):
            j = int(ends[max(np.searchsorted(ends, i + most, side="right") - 1, np.searchsorted(ends, i, side="right"))])
            yield at[small[i:j]]
            i = j
        at = at[by[np.repeat((size > most) & ~fits, size)]]
        if not len(at):
            return


def deep_leaves(length: int, most: int = SUBTREE):
    """Which windows start below an internal node of depth ``length`` or more."""

    def run(n: np.ndarray, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        size = n + length - 1
        off = np.append(0, np.flatnonzero(data == 32) + 1)
        ends = np.cumsum(size)
        lead, many = distinct(data, off[ends], first)
        out = np.repeat(many > 1, n)  # equal segments: every window is elsewhere, too
        own = lead == np.arange(len(n))
        x = np.flatnonzero(own)
        # words as places in a dictionary of the words themselves, each with the space after it
        words = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])
        word = words.dictionary_encode().indices.to_numpy()[ranges(ends[x] - size[x], size[x])]
        m, heads = n[x], np.cumsum(size[x]) - size[x]
        order = Order(word, np.repeat(heads + size[x], size[x]) - np.arange(len(word)), length)
        gone = np.zeros(len(word), bool)
        for at in parts(order, ranges(heads, m), length, most):
            by, common = order.sort(at)
            _, low, high = nodes(common, length)
            up = np.bincount(low, minlength=len(by) + 1) - np.bincount(high + 1, minlength=len(by) + 1)
            gone[at[by[np.cumsum(up[:-1]) > 0]]] = True
        out[np.repeat(own, n)] |= gone[ranges(heads, m)]
        return out

    return run


def _finish(t: Texts, gone: np.ndarray) -> dict:
    up = np.append(0, np.cumsum(gone))
    keep = np.flatnonzero(~gone)
    size = t.ends[keep] - t.starts[keep] + 1
    data = np.append(t.data, np.uint8(0x20))[ranges(t.starts[keep], size)]
    ends = np.append(0, np.cumsum(size))
    data[ends[1:] - 1] = 0x20
    at = ends[t.off - up[t.off]]
    data = data.tobytes()
    kept = [data[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]
    return {
        "n_words": np.diff(t.off).astype(np.int64),
        "n_removed": np.diff(up[t.off]).astype(np.int64),
        "kept": np.array([*(k.decode() for k in kept), None], dtype=object)[:-1],
        "kept_sha256": np.array([hashlib.sha256(k).hexdigest() for k in kept], dtype=object),
    }


def drop_repeats(docs: DataFrame, length: int = 35, text: str = "text", key: str = "doc_id", kept: bool = True, **how) -> DataFrame:
    """Removes each word covered by ``length`` words in a row that also start anywhere else.

    Words are runs of other than ASCII white space, unchanged; windows stay within a
    document and are judged on the input.  Returns doc_id, n_words, n_removed, kept
    string (the kept words joined by one space; left out if kept is false) and
    kept_sha256, a row for each row of docs.  Null texts have no words; other columns
    are left out; for repeated rows and null doc_ids see ``repeats.without``; an empty
    table gives an empty result.
    """
    schema = "n_words long, n_removed long, " + "kept string, " * kept + "kept_sha256 string"

    def finish(t: Texts, gone: np.ndarray) -> dict:
        out = _finish(t, gone)
        return out if kept else {c: x for c, x in out.items() if c != "kept"}

    rows = docs.selectExpr(f"`{key}` as doc_id", f"`{text}` as text")
    return without(rows, "word", length, max(1, length // 4), False, deep_leaves(length), finish, schema, **how)
