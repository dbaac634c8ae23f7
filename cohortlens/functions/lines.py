"""Column expressions over the lines of whole texts. Arrow's regular expressions look for all words in one pass over the bytes.

The functions that run on the executors name nothing of this package, so that workers need only pyarrow and numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a batch that are worked on at once.
PIECE = 4 << 20
#: What differs between runs, replaced in this order. Fixed values.
MARKS = [
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[t ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?z?", "<ts>"),
    (r"(/[a-z0-9_.\-]+)+", "<path>"),
    (r"\b[0-9a-f]{6,}\b", "<hash>"),
    (r"[0-9]+", "<n>"),
]


def _in_pieces(run, kind: str):
    """An Arrow function as a column function; it gets a few MB at a time, as it holds several copies of what it gets."""
    most = PIECE

    def whole(texts: pa.Array) -> pa.Array:
        step = max(1, len(texts) * most // max(texts.nbytes, 1))
        return pa.concat_arrays([run(texts.slice(i, step).cast(pa.string())) for i in range(0, max(len(texts), 1), step)])

    return F.arrow_udf(whole, kind)


def grep(text: Column, words: list[str]) -> Column:
    """The lines of a text that hold one of the words, in order, with their positions from 0."""
    pattern = "|".join(re.escape(w) for w in words)

    def run(texts):
        lines = pc.split_pattern(texts, "\n")
        flat, owner = lines.flatten(), pc.list_parent_indices(lines).to_numpy()
        hit = np.flatnonzero(pc.match_substring_regex(flat, pattern).to_numpy(zero_copy_only=False))
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        at = pa.array((hit - first[owner[hit]]).astype(np.int32))
        found = pa.StructArray.from_arrays([at, flat.take(pa.array(hit))], names=["at", "line"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[hit], np.arange(len(texts) + 1)).astype(np.int32)), found)

    return _in_pieces(run, "array<struct<at:int,line:string>>")(text)


def normalized(low: Column, salient: list[str]) -> Column:
    """Lines of a lower-cased text without what differs between runs: those with a salient word, or all but empty ones if there are none.

    No mark spans lines. Replacing takes words away and makes none, so lines without a salient word are only rewritten if all are kept.
    """
    pattern, marks = "|".join(salient), MARKS

    def plain(lines):
        for what, mark in marks:
            lines = pc.replace_substring_regex(lines, what, mark)
        return pc.utf8_trim(lines, " ")

    def holds(lines):
        return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(bool)

    def run(texts):
        lines = pc.split_pattern(texts, "\n")
        flat, owner = lines.flatten(), pc.list_parent_indices(lines).to_numpy()
        at = np.flatnonzero(holds(flat))
        some = plain(flat.take(pa.array(at)))
        left = holds(some)
        some, own = some.filter(pa.array(left)), owner[at[left]]
        has = np.zeros(len(texts), bool)
        has[own] = True
        at = np.flatnonzero(~has[owner])
        every = plain(flat.take(pa.array(at)))
        left = pc.not_equal(every, "").to_numpy(zero_copy_only=False).astype(bool)
        kept, own = pa.concat_arrays([some, every.filter(pa.array(left))]), np.concatenate([own, owner[at[left]]])
        order = np.argsort(own, kind="stable")
        ends = pa.array(np.searchsorted(own[order], np.arange(len(texts) + 1)).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(ends, kept.take(pa.array(order))), "\n")
        return pc.if_else(texts.is_valid(), joined, pa.scalar(None, pa.string()))

    return _in_pieces(run, "string")(low)
