"""Periodic run detection by enumerating maximal pairs.

A run is a stretch of consecutive words with smallest period q and at least
``max(min_words, min_exponent * q)`` words that no neighbouring word extends
keeping period q.  A run ``[s, s + n)`` of period q is the maximal pair
``(s, s + q)``: the suffixes that begin there share exactly ``n - q`` words and
the words left of them differ.  So the runs are the maximal pairs whose
distance d and shared length L satisfy ``L >= (min_exponent - 1) * d`` and
``L + d >= min_words``; nothing has to be extended afterwards.

How it runs.  Documents are independent, so this is one map over the table, a
chunk of documents at a time.  Every pair has ``L >= least(...)`` (16 words for
24 and 3): documents without a window of that many words that occurs twice in
them are done.  The others get a suffix array by prefix doubling in numpy
(document and word as the first rank, only tied suffixes sorted again), the
shared lengths of neighbours in it, and a bottom-up walk over the LCP-interval
tree.

Class lists.  A node keeps the positions below it as one list in text order,
each position with its left word as its class; a smaller child's positions are
looked up in the larger list, and pairs are formed between different children
and different classes only.  Nearest neighbours are enough: occurrences of L
words that lie within ``L / 2`` of each other are an arithmetic progression
whose difference is the period, all but its first position have the same left
word, and so the one pair that names the smallest period is the first position
and the next.  A passage that occurs m times far apart thus costs m log m
look-ups and no m * m pairs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwalk.llm.common import WORD_SEPARATORS, plain, quoted, ready, words

CHUNK_WORDS = 400_000
MIN_WORDS, MIN_EXPONENT = 24, 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def least(min_words: int, min_exponent: int) -> int:
    """The fewest words that the two suffixes of any run share."""
    return min(max(min_words - q, (min_exponent - 1) * q) for q in range(1, max(2, min_words + 1)))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a ^ (b * _A + (b >> np.uint64(32)))) * _B
    return z ^ (z >> np.uint64(31))


def _repeating(ids: np.ndarray, doc: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Positions whose window of ``size`` words occurs again in their
    document.  Windows are compared by 64-bit names; a chance match only adds
    a candidate."""
    name, have, out, done = _mix(ids.astype(np.uint64), np.full(1, size, np.uint64)), 1, None, 0
    while True:
        if size & have:
            if out is None:
                out, done = name, have
            else:
                n = max(0, len(ids) - done - have + 1)
                out, done = _mix(out[:n], name[done:done + n]), done + have
        if have * 2 > size:
            break
        n = max(0, len(name) - have)
        name, have = _mix(name[:n], name[have:have + n]), have * 2
    at = np.flatnonzero(left[:len(out)] >= size)
    key = _mix(out[at], doc[at].astype(np.uint64))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    tied = np.zeros(len(at), bool)
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    return at[tied]


def _suffix_array(ids: np.ndarray, doc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions in lexicographic order of the suffixes of their documents;
    documents apart, a document's end after every word."""
    n = len(ids)
    key = doc * (int(ids.max()) + 1) + ids
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    size = 1
    lo = np.arange(n)  # places whose suffixes are still tied with a neighbour
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        lo, new = lo[tied], new[tied]
        if not len(lo):
            return sa
        at = sa[lo]
        nxt = np.where(left[at] > size, rank[np.minimum(at + size, n - 1)], n)
        order = np.lexsort((nxt, rank[at]))
        at, nxt, old = at[order], nxt[order], rank[at[order]]
        sa[lo] = at
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])])
        rank[at] = lo[np.maximum.accumulate(np.where(new, np.arange(len(lo)), 0))]
        size *= 2


def _shared(flat: list, sa: list, starts: list, size: int) -> list:
    """For each place the words shared with the place before, 0 where these
    are fewer than ``size``.  Kasai's walk in text order, over the positions of
    ``starts`` only; ``flat`` ends every document with a symbol of its own."""
    place = dict(zip(sa, range(len(sa))))
    out, h, last = [0] * len(sa), 0, -2
    for i in starts:
        r = place[i]
        # One word on, the neighbour of i - 1 is a candidate too only while it shares ``size`` words.
        h = h - 1 if h > size and last == i - 1 else 0
        last = i
        if not r:
            h = 0
            continue
        j = sa[r - 1]
        while flat[i + h] == flat[j + h]:
            h += 1
        if h >= size:
            out[r] = h
    return out


def _pairs(flat: list, sa: list, shared: list, min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(position, distance, shared words) of the maximal pairs that satisfy
    the length constraints, from a bottom-up walk over the LCP intervals."""
    found: list[tuple[int, int, int]] = []
    ratio = min_exponent - 1

    def join(a: list, b: list, size: int) -> list:
        """Positions of both children in text order; pairs between them."""
        far, near = size // ratio if ratio else len(flat), min_words - size
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k = bisect_left(a, x)
            if k and x - a[k - 1] <= far:
                y = a[k - 1]
                if x - y >= near and flat[x - 1] != flat[y - 1]:
                    found.append((y, x - y, size))
            if k < len(a) and a[k] - x <= far:
                y = a[k]
                if y - x >= near and flat[x - 1] != flat[y - 1]:
                    found.append((x, y - x, size))
        if len(b) == 1:
            a.insert(bisect_left(a, b[0]), b[0])
        else:
            a += b
            a.sort()  # merges two sorted stretches
        return a

    stack: list[tuple[int, list]] = []
    for r, i in enumerate(sa):
        after = shared[r + 1] if r + 1 < len(sa) else 0
        if not after and not shared[r]:
            continue
        here = [i]
        while stack and stack[-1][0] >= after:
            size, before = stack.pop()
            here = join(before, here, size)
        if after:
            stack.append((after, here))
    return found


def runs_of(texts: list[list], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then
    period."""
    out: list[list] = [[] for _ in texts]
    size = least(min_words, min_exponent)
    index = dict.fromkeys(w for t in texts for w in t)
    index = dict(zip(index, range(len(index))))
    counts = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((index[w] for t in texts for w in t), np.int64, int(counts.sum()))
    doc, ends = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(ids))
    if len(ids) < size:
        return out
    again = np.unique(doc[_repeating(ids, doc, left, size)])
    if not len(again):
        return out
    keep = np.isin(doc, again)
    ids, left = ids[keep], left[keep]
    doc = np.searchsorted(again, doc[keep])
    starts = np.concatenate([[0], np.cumsum(counts[again])])
    at = _repeating(ids, doc, left, size)
    sa = _suffix_array(ids, doc, left)
    # Only suffixes with a repeated window go into the tree.  ``flat`` has a
    # symbol more in front of each document, so positions move by its number.
    wanted = np.zeros(len(ids), bool)
    wanted[at] = True
    flat = np.full(len(ids) + len(again) + 1, -1, np.int64)
    flat[np.arange(len(ids)) + doc + 1] = ids + doc * len(index)  # a word of another document is another word
    ends = starts + np.arange(len(again) + 1)
    flat[ends] = -1 - np.arange(len(again) + 1)
    flat = flat.tolist()
    sa = (sa + doc[sa] + 1)[wanted[sa]].tolist()
    shared = _shared(flat, sa, (at + doc[at] + 1).tolist(), size)
    best: dict[tuple[int, int], int] = {}
    for i, d, n in _pairs(flat, sa, shared, min_words, min_exponent):
        if d < best.get((i, n + d), d + 1):
            best[i, n + d] = d
    if best:
        begin, length = np.array(list(best), np.int64).T
        owner = np.searchsorted(ends, begin, side="right") - 1
        for k, s, n, q in sorted(zip(owner.tolist(), (begin - ends[owner] - 1).tolist(), length.tolist(), best.values()), key=lambda x: (x[0], x[1], x[3])):
            out[again[k]].append((s, n, q))
    return out


def collapsed(text: list, runs: list[tuple[int, int, int]]) -> list:
    """The words no run contains after its first period."""
    gone = np.zeros(len(text) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(text, np.cumsum(gone).tolist()) if not g]


def _scan(docs: DataFrame, text_col: str, fields: list[T.StructField], made, min_words: int, min_exponent: int, drop: bool = False) -> DataFrame:
    """``docs`` with the columns ``made`` gives for the words and runs of a
    row; the text itself doesn't travel back with ``drop``."""
    if min_words < 1 or min_exponent < 2:
        raise ValueError("min_words must be at least 1 and min_exponent 2")
    ready(docs.sparkSession)
    names = {f.name.lower() for f in fields}
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in names])
    at = docs.columns.index(text_col)
    docs, old = plain(docs)
    stay = [k for k in range(len(old)) if not (drop and k == at)]
    schema = T.StructType([*[docs.schema.fields[k] for k in stay], *fields])

    def run(batches):
        for b in batches:
            rows, chunk, n = [], [], 0

            def flush():
                for t, r in zip(chunk, runs_of(chunk, min_words, min_exponent)):
                    rows.append(made(t, r))
                chunk.clear()
            for raw in b.column(at).cast(pa.binary()):
                chunk.append(words(raw.as_py()))
                n += len(chunk[-1])
                if n >= CHUNK_WORDS:
                    flush()
                    n = 0
            flush()
            extra = [pa.array([r[k] for r in rows], f) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in stay], *extra], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type
    arrow = [to_arrow_type(f.dataType) for f in fields]
    return docs.mapInArrow(run, schema).toDF(*[old[k] for k in stay], *[f.name for f in fields])


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with ``runs``: an array of (start, length, period) in words,
    by start, then period, for every whole text.

    Null and empty texts have no runs (an empty array); equal rows are looked
    at one by one and have equal runs; an empty table gives an empty one.  A
    very long text is one chunk of its own.  An input column called ``runs`` is
    replaced, all others pass through."""
    return _scan(docs, text_col, [T.StructField("runs", T.ArrayType(_RUN))],
                 lambda text, runs: [[{"start": s, "length": n, "period": q} for s, n, q in runs]], min_words, min_exponent)


def collapse_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with ``collapsed``: the words of the text that no run contains
    after its first period, joined by one space.  Null texts give an empty
    string; rows, clashing names and empty tables as in :func:`periodic_runs`."""
    return _scan(docs, text_col, [T.StructField("collapsed", T.StringType())],
                 lambda text, runs: [b" ".join(collapsed(text, runs)).decode()], min_words, min_exponent)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's input: of documents whose id's CRC-32 h is divisible by 10
    the words from word ``a = g % n`` on (g = h // 10) repeat with period
    ``1 + (n - a) // (3 + g % 8)``.  Rows with a null id or no word stay."""
    h = F.crc32(quoted(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(ws):
        n = F.size(ws).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(ws, i.cast("int"))), " ")

    split = F.filter(F.split(quoted(text_col), WORD_SEPARATORS), lambda w: w != "")
    changed = F.transform(F.array(split), lambda ws: F.when(F.size(ws) > 0, repeat(ws)))[0]  # names the words once
    return docs.select(quoted(id_col), F.when((h % 10 == 0) & quoted(text_col).isNotNull(), F.coalesce(changed, quoted(text_col)))
                       .otherwise(quoted(text_col)).alias("text"))


def runs_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Query form: number of runs, the run of greatest length / period (ties:
    smallest start, then period) and digests of all runs and of the collapsed
    text."""
    def made(text, runs):
        top = None
        for s, n, q in runs:
            if top is None or n * top[2] > top[1] * q:  # runs come by start, then period
                top = s, n, q
        one = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        two = hashlib.sha256(b" ".join(collapsed(text, runs) if runs else text)).hexdigest()
        return [len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, one, two]
    longs = [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")]
    texts = [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
    out = _scan(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), "text", [*longs, *texts], made, min_words, min_exponent, drop=True)
    return out.select("doc_id", *[f.name for f in longs + texts])
