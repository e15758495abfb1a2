"""Token-id files coded with a static range asymmetric numeral system (rANS).

Documents are range-partitioned into ascending id order, encoded with the
tokenizers library, closed with an end id, and written as a Parquet dataset
with one row per chunk of up to ``CHUNK`` ids.  Chunks are cut regardless of
document ends, so their number follows the ids and no row grows with a document.

A chunk holds one frequency table (scaled to 2**``BITS``), shared by its
blocks.  Each block of ``BLOCK`` ids is coded on its own with ``LANES`` interleaved
64-bit states that share one stream of 32-bit words.  After every
``STEPS`` steps a checkpoint notes the states and the place in the stream, so the
segments of a block decode in parallel - numpy advances all lanes of all
segments of a chunk together - and each segment must end exactly in the state the
next checkpoint notes.  A CRC-32 of the ids guards every block.

Rows carry what a reader needs to find any document without the rows before:
part (ascending with the ids), chunk number, first id position in the
part, and ids and lengths of the documents in the chunk.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwalk.llm.bpe import MEMO_BYTES, WORDS_AT_ONCE, Codec, kept, load
from cartwalk.llm.common import quoted, ready, shuffle_partitions, stored
from cartwalk.session import scratch_path

BITS, LANES, STEPS = 20, 64, 512
BLOCK, CHUNK = 1 << 16, 1 << 20
_LOW = np.uint64(1 << 31)
_U = np.uint64


# -- frequency tables --------------------------------------------------------

def scaled(counts: np.ndarray) -> np.ndarray:
    """Positive ``counts`` scaled to add up to 2**BITS, each at least 1; the
    rounding difference is taken from or given to the largest ones."""
    total = 1 << BITS
    f = np.maximum(1, counts.astype(np.int64) * total // int(counts.sum()))
    over = int(f.sum()) - total
    if over < 0:
        f[int(np.argmax(counts))] -= over
    while over > 0:
        order = np.argsort(-f, kind="stable")[:over]
        cut = np.minimum(f[order] - 1, max(1, over // max(1, len(order))))
        left = np.minimum(np.cumsum(cut), over)
        cut = np.diff(np.concatenate([[0], left]))
        f[order] -= cut
        over -= int(cut.sum())
    return f


def _table_bytes(symbols: np.ndarray, freqs: np.ndarray) -> bytes:
    gaps = np.diff(symbols, prepend=-1).astype("<u4")
    return zlib.compress(struct.pack("<I", len(symbols)) + gaps.tobytes() + freqs.astype("<u4").tobytes(), 6)


def _table_read(data: bytes):
    raw = zlib.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    gaps = np.frombuffer(raw, "<u4", n, 4).astype(np.int64)
    return np.cumsum(gaps) - 1, np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64)


# -- blocks ------------------------------------------------------------------

def _encode_blocks(sym: np.ndarray, freq: np.ndarray, start: np.ndarray):
    """Code blocks (blocks, steps, lanes) of symbol numbers.  Gives for each
    block its words, and for each segment (place, states)."""
    blocks, steps, lanes = sym.shape
    x = np.full((blocks, lanes), _LOW, _U)
    out_word, out_block, emitted, marks = [], [], np.zeros(blocks, np.int64), []
    top = _U(1 << (31 - BITS + 32))
    for t in range(steps - 1, -1, -1):
        s = sym[:, t, :]
        f = freq[s]
        full = x >= f * top
        b, lane = np.nonzero(full)
        if len(b):
            out_word.append((x[b, lane] & _U(0xFFFFFFFF)).astype(np.uint32))
            out_block.append(b.astype(np.int16))
            x[b, lane] >>= _U(32)
            emitted += np.bincount(b, minlength=blocks)
        q = x // f
        x = (q << _U(BITS)) + (x - q * f) + start[s]
        if t % STEPS == 0:
            marks.append((emitted.copy(), x.copy()))
    if out_word:
        word, block = np.concatenate(out_word[::-1]), np.concatenate(out_block[::-1])
        order = np.argsort(block, kind="stable")
        words = np.split(word[order], np.cumsum(np.bincount(block, minlength=blocks))[:-1])
    else:
        words = [np.zeros(0, np.uint32)] * blocks
    marks.reverse()
    return [(words[i], [(int(emitted[i] - e[i]), st[i]) for e, st in marks]) for i in range(blocks)]


def _decode_segments(x, place, after_x, after_place, steps, words, freq, start, lookup):
    """Decode segments side by side; raises if one does not end where it must."""
    out = np.empty((len(x), steps, x.shape[1]), np.int32)
    x, place, mask = x.copy(), place.copy(), _U((1 << BITS) - 1)
    for t in range(steps):
        slot = x & mask
        s = lookup[slot]
        out[:, t, :] = s
        x = freq[s] * (x >> _U(BITS)) + slot - start[s]
        low = x < _LOW
        count = np.cumsum(low, axis=1)
        at = (place[:, None] + count - 1)[low]
        x[low] = (x[low] << _U(32)) | words[at]
        place += count[:, -1]
    if not (np.array_equal(x, after_x) and np.array_equal(place, after_place)):
        raise ValueError("token file: a segment does not end at its checkpoint")
    return out


def encode_chunk(ids: np.ndarray) -> bytes:
    """The bytes of a chunk: header, frequency table, checkpoints, words."""
    if len(ids) and 0 <= ids.min() and ids.max() < 1 << 22:  # as ids of a vocabulary are: no sort
        every = np.bincount(ids)
        symbols = np.flatnonzero(every)
        counts, number = every[symbols], (np.cumsum(every > 0, dtype=np.int32) - 1)[ids]
    else:
        symbols, number, counts = np.unique(ids, return_inverse=True, return_counts=True)
    f = scaled(counts)
    table = _table_bytes(symbols, f)
    freq, start = f.astype(_U), (np.cumsum(f) - f).astype(_U)
    pad = int(np.argmax(counts))
    parts, head = [], []
    whole = len(ids) // BLOCK
    groups = []
    if whole:
        groups.append((number[:whole * BLOCK].reshape(whole, BLOCK // LANES, LANES), [BLOCK] * whole))
    rest = number[whole * BLOCK:]
    if len(rest):
        padded = np.concatenate([rest, np.full(-len(rest) % LANES, pad, rest.dtype)])
        groups.append((padded.reshape(1, -1, LANES), [len(rest)]))
    done = 0
    for sym, sizes in groups:
        for (words, marks), n in zip(_encode_blocks(sym, freq, start), sizes):
            crc = zlib.crc32(ids[done:done + n].astype("<u4").tobytes())
            done += n
            head.append(struct.pack("<IIII", n, len(words), len(marks), crc))
            parts.append(b"".join([*[struct.pack("<I", p) + st.astype("<u8").tobytes() for p, st in marks], words.astype("<u4").tobytes()]))
    return b"".join([b"RANS", struct.pack("<III", len(ids), len(head), len(table)), table, *head, *parts])


def decode_chunk(data: bytes) -> np.ndarray:
    """The ids of a chunk; raises ValueError if it is damaged."""
    if data[:4] != b"RANS":
        raise ValueError("token file: not a chunk")
    n, blocks, size = struct.unpack_from("<III", data, 4)
    symbols, f = _table_read(data[16:16 + size])
    freq, start = f.astype(_U), (np.cumsum(f) - f).astype(_U)
    lookup = np.repeat(np.arange(len(f), dtype=np.int32), f)
    heads = [struct.unpack_from("<IIII", data, 16 + size + 16 * i) for i in range(blocks)]
    at = 16 + size + 16 * blocks
    segments: dict[int, list] = {}
    pools, base = [], 0
    for block, (count, n_words, marks, _) in enumerate(heads):
        seen = []
        for _ in range(marks):
            seen.append((base + struct.unpack_from("<I", data, at)[0], np.frombuffer(data, "<u8", LANES, at + 4).astype(_U)))
            at += 4 + 8 * LANES
        pools.append(np.frombuffer(data, "<u4", n_words, at))
        at, base = at + 4 * n_words, base + n_words
        seen.append((base, np.full(LANES, _LOW, _U)))
        steps = -(-count // LANES)
        for k in range(marks):
            segments.setdefault(min(STEPS, steps - k * STEPS), []).append((block, k, *seen[k], *seen[k + 1]))
    words = np.concatenate([*pools, np.zeros(0, np.uint32)]).astype(_U)
    got: dict[tuple[int, int], np.ndarray] = {}
    for steps, segs in segments.items():
        out = _decode_segments(np.stack([s[3] for s in segs]), np.array([s[2] for s in segs]), np.stack([s[5] for s in segs]),
                               np.array([s[4] for s in segs]), steps, words, freq, start, lookup)
        got.update({(s[0], s[1]): o.ravel() for s, o in zip(segs, out)})
    ids = []
    for block, (count, _, marks, crc) in enumerate(heads):
        one = symbols[np.concatenate([got[block, k] for k in range(marks)])[:count]].astype("<u4")
        if zlib.crc32(one.tobytes()) != crc:
            raise ValueError("token file: checksum of a block differs")
        ids.append(one)
    out = np.concatenate([*ids, np.zeros(0, "<u4")])
    if len(out) != n:
        raise ValueError("token file: wrong number of ids")
    return out


# -- tokenizing --------------------------------------------------------------

class LibraryEncoder(Codec):
    """Whole texts to ids with the tokenizers library.

    The file's pre-tokenizer never joins what white space separates, so the ids of
    a text are those of its parts (as :class:`Codec` cuts them) one behind the
    other.  Each distinct part goes through the library once and is remembered in
    bounded memory.  Thousands of parts share a call, with spaces between; where a part
    ends shows in the ids, since only the last token of a part has the word end."""

    def __init__(self, tables: dict, spec: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import WhitespaceSplit
        super().__init__(tables)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # ASCII parts are as the normalizer leaves them and one part each: only the model is left to run.
        self.model = Tokenizer.from_str(spec)
        self.model.normalizer, self.model.pre_tokenizer = Sequence([]), WhitespaceSplit()
        self.model.no_truncation()
        self.model.no_padding()
        self.is_end = np.array([t.endswith("</w>") for t in self.tokens])
        self.memo.limit = 2 * MEMO_BYTES  # words met again after the memo was emptied cost more than any other step

    def _ids(self, texts: list[str], by=None) -> list[list[int]]:
        return [e.ids for e in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts and their number by part."""
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(parts), WORDS_AT_ONCE):
            some = parts[lo:lo + WORDS_AT_ONCE]
            plain = np.fromiter(map(str.isascii, some), bool, len(some))
            n, ids = np.empty(len(some), np.int64), []
            for mask in (plain, ~plain):
                got, n[mask] = self._some(list(itertools.compress(some, mask.tolist())))
                ids.append(got)
            of_plain = np.repeat(plain, n)
            every = np.empty(len(of_plain), np.int32)
            every[of_plain], every[~of_plain] = ids
            flat.append(every)
            sizes.append(n)
        return np.concatenate(flat), np.concatenate(sizes)

    def _some(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not some:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        joined = " ".join(some)
        ascii = joined.isascii()
        ids = np.array(self._ids([joined], self.model if ascii else None)[0], np.int32)
        n = np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)
        if len(n) != len(some) or not ascii and self._normal(joined) != joined:
            # A part that the library would normalise once more or cut anew.
            runs = self._ids(some)
            ids, n = np.array([i for r in runs for i in r], np.int32), np.array([len(r) for r in runs], np.int64)
        return ids, n


# -- writing and reading -----------------------------------------------------

def _chunk_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("part", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("first", T.LongType()),
                         T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType()),
                         T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.ArrayType(T.LongType())),
                         T.StructField("goes_on", T.BooleanType())])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the token ids of ``docs`` under ``path`` in ascending order of
    ``id_col`` (nulls first; rows of one id by the hash of their text) and
    return the path.  Null and empty texts have only the end id.  ``tokenizer``
    is the path of a tokenizer file, read on the driver."""
    spark = ready(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    shared, key = spark.sparkContext.broadcast((load(tokenizer), spec)), ("library", zlib.crc32(spec.encode()))
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    order = [F.col("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    schema = _chunk_schema(kind)

    def run(batches):
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = kept(key, lambda: LibraryEncoder(*shared.value))
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names, sizes, n, chunk, first, goes_on = [], [], 0, 0, 0, False

        def flush():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                pa.array([encode_chunk(ids)], pa.binary()), pa.array([names], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([goes_on], pa.bool_())], names=schema.names)
        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for name, ids in zip(b.column(0).to_pylist(), encoder.encode_batch(b.column(1).cast(pa.binary()).to_pylist())):
                ids = np.append(ids, np.int32(end_id))
                begun = False
                while len(ids):
                    take = ids[:CHUNK - n]
                    held.append(take)
                    if begun and not names:
                        goes_on = True  # the chunk begins inside a document
                    names.append(name)
                    sizes.append(len(take))
                    n, ids, begun = n + len(take), ids[len(take):], True
                    if n == CHUNK:
                        yield flush()
                        held, names, sizes, chunk, first, n, goes_on = [], [], [], chunk + 1, first + n, 0, False
        if n:
            yield flush()
    dealt.mapInArrow(run, schema).write.mode("error").parquet(path)
    return path


def _combine(crc1: int, crc2: int, size2: int) -> int:
    """CRC-32 of two byte strings put together, from their own ones: advancing
    a CRC over zero bytes is linear over GF(2), so its matrix is squared."""
    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out
    m = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        m = [times(m, c) for c in m]
    while size2:
        if size2 & 1:
            crc1 = times(m, crc1)
        m = [times(m, c) for c in m]
        size2 >>= 1
    return crc1 ^ crc2


def read(spark, path: str) -> DataFrame:
    """The chunks of a dataset with their ids: part, chunk, first, ids and
    sizes of the documents, goes_on, tokens (array of int)."""
    ready(spark)
    chunks = spark.read.parquet(path)
    schema = T.StructType([f for f in chunks.schema.fields if f.name != "data"] + [T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("data")
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                ids = decode_chunk(row.column(at)[0].as_py()).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[row.column(k) for k in range(b.num_columns) if k != at], lists], names=schema.names)
    return chunks.mapInArrow(run, schema)


def catalogue(spark, path: str) -> DataFrame:
    """One row per document, read back from the files: id, start (ids of all
    documents before it), n_tokens and the CRC-32 of its ids as little-endian
    unsigned 32-bit integers."""
    ready(spark)
    chunks = spark.read.parquet(path)
    kind = chunks.schema["ids"].dataType.elementType
    fields = [T.StructField("id", kind), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("head", T.BooleanType()),
              T.StructField("tail", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())]
    schema = T.StructType(fields)

    def run(batches):
        for b in batches:
            col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                ids = decode_chunk(col["data"][i].as_py())
                sizes = col["sizes"][i].as_py()
                ends = list(itertools.accumulate(sizes))
                first, k = col["first"][i].as_py(), len(sizes)
                crcs = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, sizes)]
                full = col["n"][i].as_py() == CHUNK
                yield pa.RecordBatch.from_arrays([
                    col["ids"][i].values, pa.array([col["part"][i].as_py()] * k, pa.int32()), pa.array([first + e - n for e, n in zip(ends, sizes)], pa.int64()),
                    pa.array([not (col["goes_on"][i].as_py() and j == 0) for j in range(k)]), pa.array([full and j == k - 1 for j in range(k)]),
                    pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=schema.names)
    # Read twice below; stored, so that chunks are decoded once.
    pieces = stored(chunks.select("part", "first", "n", "data", "ids", "sizes", "goes_on").mapInArrow(run, schema))

    # Documents cut by a chunk's end: runs of pieces in one part, of which the
    # later ones are no heads.  Only the first and last piece of a chunk can be one.
    @F.udf("bigint")
    def joined(run):
        crc = 0
        for piece in run:
            crc = _combine(crc, piece["crc"], 4 * piece["n"])
        return crc
    edge = ~F.col("head") | F.col("tail")
    cut = pieces.filter(edge).withColumn("run", F.sum(F.col("head").cast("int")).over(
        Window.partitionBy("part").orderBy("at")))
    whole = cut.groupBy("part", "run").agg(
        F.min_by("id", "at").alias("id"), F.min("at").alias("at"), F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces")).select("id", "part", "at", "n", joined("pieces").alias("crc"))
    every = pieces.filter(~edge).select("id", "part", "at", "n", "crc").unionByName(whole)
    # One row per part.
    totals = chunks.groupBy("part").agg(F.sum("n").alias("_n"))
    before = totals.select("part", F.coalesce(F.sum("_n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return every.join(F.broadcast(before), "part").select(
        "id", (F.col("_before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def files_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Query form: write the files under the shared checkpoint folder, then
    read every document back from them."""
    spark = docs.sparkSession
    path = write(docs, scratch_path(spark, f"tokens-{uuid.uuid4().hex}"), tokenizer, end_id)
    return catalogue(spark, path).withColumnRenamed("id", "doc_id")
