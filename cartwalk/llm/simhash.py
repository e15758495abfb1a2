"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint has a bit for each of the 64 hash bits that is set in
more than half of its word shingles (repeats counted).  Documents whose
fingerprints differ in at most ``max_bits`` bits are linked, and a group is a
connected component of links.

Links.  Fingerprints are first made distinct, so copies cost one row.  For each
the Hamming distances to ``PIVOTS`` fixed reference fingerprints are tabulated.
By the triangle inequality two fingerprints within ``max_bits`` of each other
have tables that differ by at most ``max_bits`` in every coordinate, so a pair
with a larger coordinate difference is discarded from the tables alone; the
survivors are verified on the fingerprints.

Comparing every table with every other would be a cross join.  Pairs are
therefore looked for only among fingerprints that agree on some key: the 64
bits are cut into ``max_bits + 2`` pieces, and of any two within ``max_bits``
at least two pieces agree, so every choice of two pieces is a key.  A key shared by more than
``crowd`` fingerprints is not compared pairwise; its members get longer keys
(the bits not yet in the key are cut the same way), until what is left open
allows few distinct fingerprints.  This loses no pair at any size: each step
is the same pigeonhole argument on the bits that may still differ.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwalk.llm.common import fresh, quoted, ready, stored, word_pieces
from cartwalk.llm.components import components

PIVOTS = 16
CROWD = 64
SEED = 42


def _hashes(raw: bytes | None, shingle: int):
    """XXH64 of the word shingles, piece by piece."""
    carry: list[bytes] = []
    n = 0
    for piece in word_pieces(raw.lower() if raw else raw):
        w = carry + piece
        n += len(piece)
        if len(w) >= shingle:
            joined = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if shingle > 1 else w
            yield np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], ">u8")
        carry = w[-(shingle - 1):] if shingle > 1 else []
    if 0 < n < shingle:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], ">u8")


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text, as a signed integer; 0 without words."""
    total, n = np.zeros(64, np.int64), 0
    for h in _hashes(raw, shingle):
        for lo in range(0, len(h), 1 << 16):
            part = h[lo:lo + (1 << 16)]
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += len(part)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint) of every row; null and empty texts get 0."""
    ready(docs.sparkSession)
    pair = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind = pair.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raws = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(r, shingle) for r in raws], pa.int64())],
                                             names=["id", "fingerprint"])
    return pair.mapInArrow(run, f"id {kind}, fingerprint bigint")


def _pivots(n: int) -> list[int]:
    """Reference fingerprints by a fixed rule: XXH64 of their numbers."""
    return [int.from_bytes(xxhash.xxh64_digest(bytes([i]), SEED), "big", signed=True) for i in range(n)]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _choices(open_bits: list[int], max_bits: int) -> list[list[int]]:
    """Ways to take two of ``max_bits + 2`` pieces of the open bits."""
    cut = [c.tolist() for c in np.array_split(np.array(open_bits), max_bits + 2)]
    return [sum(pair, []) for pair in itertools.combinations(cut, 2)]


def near_pairs(prints: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of distinct values of ``prints.fingerprint`` that differ
    in at most ``max_bits`` bits.  A pair may come up more than once."""
    distinct = prints.select("fingerprint").filter("fingerprint IS NOT NULL").distinct()
    table = F.array(*[F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(p))).cast("tinyint") for p in _pivots(PIVOTS)])
    rows = stored(distinct.withColumn("dist", table))
    keys = [_mask(c) for c in _choices(list(range(64)), max_bits)]
    keyed = rows.select("fingerprint", "dist", F.explode(F.array(*[F.lit(k) for k in keys])).alias("mask"))
    found = None
    while True:
        keyed = keyed.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = stored(keyed.join(sizes, ["mask", "key"]))
        # Two open pieces or fewer bits than pieces: nothing is left to cut.
        last = 64 - F.bit_count("mask") <= 2 * (max_bits + 2)
        small = shared.filter((F.col("n") <= crowd) | last)
        x = small.select("mask", "key", F.col("fingerprint").alias("a"), F.col("dist").alias("da"))
        y = small.select("mask", "key", F.col("fingerprint").alias("b"), F.col("dist").alias("db"))
        tables_agree = F.lit(True)
        for i in range(PIVOTS):
            tables_agree = tables_agree & (F.abs(F.col("da")[i].cast("int") - F.col("db")[i].cast("int")) <= max_bits)
        pairs = (x.join(y, ["mask", "key"]).filter(F.col("a") < F.col("b")).filter(tables_agree)
                 .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b"))
        found = pairs if found is None else found.unionByName(pairs)
        crowded = shared.filter((F.col("n") > crowd) & ~last)
        masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # as many as key choices at most
        if not masks:
            return found
        longer = {m: [m | _mask(c) for c in _choices([b for b in range(64) if not m >> b & 1], max_bits)] for m in masks}
        step = F.create_map(*[v for m, ks in longer.items() for v in (F.lit(m), F.array(*[F.lit(k) for k in ks]))])
        # The same longer mask can be reached from several shorter ones.
        keyed = crowded.select("fingerprint", "dist", F.explode(step[F.col("mask")]).alias("mask")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (bigint) and
    component_id, the smallest id of its group, itself included.

    Null and empty texts have fingerprint 0 and link like any other.  Rows with
    a null id get their group's smallest id (null if it has none); repeated
    rows and ids stay as they are.  An empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    roots = components(near_pairs(prints, max_bits))
    named = prints.groupBy("fingerprint").agg(F.min("id").alias("first")).join(
        roots.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = stored(named.join(least, "root").select("fingerprint", "component_id"))
    return prints.join(groups, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of the
    smallest id, null ids last, and of rows that share it the first by a stored
    row key."""
    row = fresh("_row", docs)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    key = F.struct(quoted(id_col).isNull().alias("none"), quoted(id_col).alias("id"), F.col(row).alias("row"))
    groups = near_duplicates(rows.select(key.alias("id"), quoted(text_col).alias("text")), "id", "text", shingle, max_bits)
    keep = groups.select(F.col("component_id")["row"].alias("_keep")).distinct()
    return rows.join(keep, F.col(row) == F.col("_keep"), "left_semi").select(*[quoted(c) for c in docs.columns])


def near_duplicates_digest(docs: DataFrame) -> DataFrame:
    """Query form: fingerprints as 16 lowercase hexadecimal digits."""
    out = near_duplicates(docs, "doc_id", "text", 3, 2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
