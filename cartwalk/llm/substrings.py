"""Substring dedup by level-wise doubling.

Every window of ``min_words`` consecutive words whose word sequence also
starts somewhere else - in another document or in the same one - is found, and
all words such windows cover are removed.  Lengths are reached by doubling:
the shortest level names all its windows; a window of the next level (up to
twice as long) is looked at only if both of its halves were repeated at the
level before.  Few windows survive the first level, so later levels are cheap,
and a level without candidates ends the search.

How it runs.  Documents are dealt into buckets by a hash (one shuffle of the
texts, reused by every pass).  Each pass names the windows of a bucket with
numpy and sends, per name range, the sorted *distinct* names of the bucket and
one bit telling whether a name occurs there more than once.  The task of a name
range sees which names are repeated anywhere and answers each bucket with one
bit per name it sent.  A passage shared by a third of all documents is thus
sent once per bucket, not once per document, and no pairs are ever formed.

Names.  Words are hashed to 64 bits; the name of a window of length a+b mixes
the names of its two parts.  Levels before the last are a filter only and send
40 bits of a name beside the range it belongs to; a chance match merely costs
a candidate.  The last level compares 96 bits, so two different windows are
taken for equal with probability about n^2 / 2^97 among n surviving windows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwalk.llm.common import plain, quoted, ready, shuffle_partitions, words

SHORT_BITS = 40
FIRST_LENGTH = 18
_A, _B, _C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def lengths(min_words: int, first: int = FIRST_LENGTH) -> list[int]:
    """Window lengths of the levels, shortest first; each is at most twice
    the one before and the last is ``min_words``."""
    out = [min_words]
    while out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _mix(a, b):
    z = a * _A + b
    z ^= z >> np.uint64(31)
    z *= _B
    z ^= z >> np.uint64(29)
    z *= _C
    return z ^ (z >> np.uint64(32))


def _base_names(h: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of ``length`` words over the word hashes ``h``,
    built from windows of 1, 2, 4, ... words."""
    name, have, done = h, 1, None
    size = 0
    while True:
        if length & have:
            if done is None:
                done, size = name, have
            else:
                n = len(h) - size - have + 1
                done, size = _mix(done[:n], name[size:size + n]), size + have
        if have * 2 > length:
            return done
        n = len(name) - have
        name, have = _mix(name[:n], name[have:have + n]), have * 2


class _Bucket:
    """The windows of one bucket of documents, level by level."""

    def __init__(self, raws, levels, ranges):
        self.levels, self.ranges = levels, ranges
        parts = [np.array([xxhash.xxh64_intdigest(w) for w in words(r)], np.uint64) for r in raws]
        self.counts = np.array([len(p) for p in parts], np.int64)
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        ends = np.cumsum(self.counts)
        self.starts = ends - self.counts
        self.left = np.repeat(ends, self.counts) - np.arange(len(h))  # words to the document's end
        self.level = 0
        first = levels[0]
        self.at = np.flatnonzero(self.left >= first)
        self.names = _base_names(h, first) if len(h) >= first else np.zeros(0, np.uint64)
        # Only looked at if the first level is the last as well.
        self.check = _base_names(_mix(h, _C), first) if len(h) >= first and len(levels) == 1 else self.names
        self._key()

    def _key(self):
        """Sorted distinct names of the windows at ``self.at``: range number,
        name, check; ``inverse`` leads from windows to them."""
        mine = self.names[self.at]
        rng = (mine % np.uint64(self.ranges)).astype(np.uint64)
        if self.level < len(self.levels) - 1:
            name, check = mine >> np.uint64(64 - SHORT_BITS), None
            key = (rng << np.uint64(SHORT_BITS)) | name
            u, self.inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            self.u_range, self.u_name, self.u_check = u >> np.uint64(SHORT_BITS), u & np.uint64((1 << SHORT_BITS) - 1), None
            self.multi = n > 1
            return
        check = (self.check[self.at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((check, mine, rng))
        r, m, c = rng[order], mine[order], check[order]
        new = np.ones(len(r), bool)
        new[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
        group = np.cumsum(new) - 1
        self.inverse = np.empty(len(r), np.int64)
        self.inverse[order] = group
        self.u_range, self.u_name, self.u_check = r[new], m[new], c[new]
        self.multi = np.bincount(group, minlength=int(new.sum())) > 1

    def sent(self):
        """(range, names, flags) for each name range this bucket has names in."""
        present, first = np.unique(self.u_range, return_index=True)
        for k, (rng, lo) in enumerate(zip(present.tolist(), first.tolist())):
            hi = int(first[k + 1]) if k + 1 < len(first) else len(self.u_range)
            yield rng, _pack(self.u_name[lo:hi], None if self.u_check is None else self.u_check[lo:hi]), np.packbits(self.multi[lo:hi]).tobytes()

    def answered(self, replies: dict[int, bytes]):
        """Take the answers of this level: which windows are repeated."""
        rep = np.zeros(len(self.u_range), bool)
        present, first = np.unique(self.u_range, return_index=True)
        for k, (rng, lo) in enumerate(zip(present.tolist(), first.tolist())):
            hi = int(first[k + 1]) if k + 1 < len(first) else len(self.u_range)
            rep[lo:hi] = np.unpackbits(np.frombuffer(replies[rng], np.uint8), count=hi - lo).astype(bool)
        self.repeated = np.zeros(len(self.left), bool)
        self.repeated[self.at[rep[self.inverse]]] = True

    def extend(self):
        """Move to the next level: only windows both of whose halves were
        repeated at this one."""
        a, b = self.levels[self.level], self.levels[self.level + 1]
        step, n = b - a, len(self.left) - b + 1
        self.level += 1
        if n <= 0:
            self.at, self.names, self.check = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        else:
            ok = self.repeated[:n] & self.repeated[step:step + n] & (self.left[:n] >= b)
            self.at = np.flatnonzero(ok)
            x, y = self.names[self.at], self.names[self.at + step]
            names, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            names[self.at], check[self.at] = _mix(x, y), _mix(y ^ _C, x)
            self.names, self.check = names, check
        self._key()

    def covered(self) -> np.ndarray:
        """Words under a repeated window of the last level."""
        edge = np.zeros(len(self.left) + 1, np.int64)
        at = np.flatnonzero(self.repeated)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.levels[-1], -1)
        return np.cumsum(edge[:-1]) > 0


def _pack(names, checks) -> bytes:
    if checks is None:
        return np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8)[:, :SHORT_BITS // 8]).tobytes()
    return names.tobytes() + checks.tobytes()


def _unpack(data: bytes, last: bool):
    if last:
        n = len(data) // 12
        return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n)
    n = len(data) // (SHORT_BITS // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :SHORT_BITS // 8] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return out.view(np.uint64).ravel(), None


def _texts(table: pa.Table, column: str) -> list:
    return table.column(column).cast(pa.binary()).to_pylist()


def _through(bucket: _Bucket, replies: pa.Table | None, upto: int) -> None:
    """Advance ``bucket`` through the levels that have been answered."""
    by: dict[int, dict[int, bytes]] = {k: {} for k in range(upto)}
    if replies is not None:
        for lv, rng, bits in zip(*(replies.column(c).to_pylist() for c in ("level", "rng", "bits"))):
            by[lv][rng] = bits
    for k in range(upto):
        bucket.answered(by[k])
        if k + 1 < len(bucket.levels):
            bucket.extend()


SENT = "rng int, src int, names binary, flags binary"
REPLY = "src int, level int, rng int, bits binary"


def _sent_table(bucket: _Bucket, src: int) -> pa.Table:
    rows = list(bucket.sent())
    return pa.table({
        "rng": pa.array([r[0] for r in rows], pa.int32()), "src": pa.array([src] * len(rows), pa.int32()),
        "names": pa.array([r[1] for r in rows], pa.binary()), "flags": pa.array([r[2] for r in rows], pa.binary())})


def _sender(text_col: str, src: str, levels: list[int], ranges: int, level: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"rng": pa.array([], pa.int32()), "src": pa.array([], pa.int32()),
                             "names": pa.array([], pa.binary()), "flags": pa.array([], pa.binary())})
        bucket = _Bucket(_texts(left, text_col), levels, ranges)
        _through(bucket, right, level)
        return _sent_table(bucket, left.column(src)[0].as_py())
    return send


def _first_sender(text_col: str, src: str, levels: list[int], ranges: int):
    send = _sender(text_col, src, levels, ranges, 0)
    return lambda left: send(left, None)


def _answer(level: int, last: bool):
    def answer(table: pa.Table) -> pa.Table:
        rng = table.column("rng")[0].as_py()
        srcs, names, flags = (table.column(c).to_pylist() for c in ("src", "names", "flags"))
        got = [_unpack(d, last) for d in names]
        size = [len(g[0]) for g in got]
        name = np.concatenate([g[0] for g in got])
        multi = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(flags, size)]).astype(bool)
        if last:
            check = np.concatenate([g[1] for g in got])
            order = np.lexsort((check, name))
            m, c = name[order], check[order]
            same = (m[1:] == m[:-1]) & (c[1:] == c[:-1])
        else:
            order = np.argsort(name, kind="stable")
            m = name[order]
            same = m[1:] == m[:-1]
        group = np.concatenate([[0], np.cumsum(~same)])
        hit = (np.bincount(group) > 1) | (np.bincount(group, weights=multi[order]) > 0)
        rep = np.empty(len(order), bool)
        rep[order] = hit[group]
        bits = [np.packbits(x).tobytes() for x in np.split(rep, np.cumsum(size)[:-1])]
        return pa.table({
            "src": pa.array(srcs, pa.int32()), "level": pa.array([level] * len(srcs), pa.int32()),
            "rng": pa.array([rng] * len(srcs), pa.int32()), "bits": pa.array(bits, pa.binary())})
    return answer


def remove_repeats(docs: DataFrame, text_col: str = "text", min_words: int = 35) -> DataFrame:
    """``docs`` with ``text_col`` reduced to the words that no repeated window
    of ``min_words`` words covers (joined by one space where any word went; a
    document that loses none keeps its text as it is) and two columns more:
    ``n_words`` and ``n_removed``.

    Every row is a document of its own, equal rows included, so exact copies
    of ``min_words`` words or more lose everything.  Windows are judged on the
    input.  A null text has no words and stays null; texts shorter than a
    window keep all words.  Input columns called ``n_words`` or ``n_removed``
    are replaced; all others pass through.  An empty table gives an empty one.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    spark = ready(docs.sparkSession)
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("n_words", "n_removed")])
    levels, ranges = lengths(min_words), shuffle_partitions(spark)
    text_col, src = f"c{docs.columns.index(text_col)}", "src"
    docs, names = plain(docs)
    keyed = docs.withColumn(src, F.pmod(F.xxhash64(*[quoted(c) for c, t in docs.dtypes if not t.startswith(("map", "variant"))]), F.lit(ranges)).cast("int"))
    by_src = keyed.groupBy(src)
    replies = None
    for k in range(len(levels)):
        last = k == len(levels) - 1
        if replies is None:
            sent = by_src.applyInArrow(_first_sender(text_col, src, levels, ranges), SENT)
        else:
            sent = by_src.cogroup(replies.groupBy("src")).applyInArrow(_sender(text_col, src, levels, ranges, k), SENT)
        got = sent.groupBy("rng").applyInArrow(_answer(k, last), REPLY)
        replies = got if replies is None else replies.unionByName(got)

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = left.drop_columns([src])
        raws = _texts(left, text_col)
        b = _Bucket(raws, levels, ranges)
        _through(b, right, len(levels))
        gone = b.covered()
        out, removed = [], []
        for raw, lo, n in zip(raws, b.starts.tolist(), b.counts.tolist()):
            mask = gone[lo:lo + n]
            removed.append(int(mask.sum()))
            out.append(raw if not removed[-1] else b" ".join(itertools.compress(words(raw), ~mask)))
        i = keep.schema.get_field_index(text_col)
        keep = keep.set_column(i, keep.schema.field(i).name, pa.array(out, pa.binary()).cast(pa.string()))
        return keep.append_column("n_words", pa.array(b.counts, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    return by_src.cogroup(replies.groupBy("src")).applyInArrow(cut, schema).toDF(*names, "n_words", "n_removed")


def repeats_digest(docs: DataFrame, min_words: int = 35) -> DataFrame:
    """Query form: doc_id, n_words, n_removed and the SHA-256 of the kept
    words joined by one space."""
    cut = remove_repeats(docs.select("doc_id", "text"), "text", min_words)
    plain = F.concat_ws(" ", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(plain, 256).alias("kept_sha256"))
