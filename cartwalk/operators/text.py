"""Item text, bag-of-words encoding and cosine retrieval.

Documents and queries become long tables ``(id, term, tf)``; the vocabulary
is the most frequent terms.  Retrieval (T9, T10) and all-pairs similarity
(T12) are pruned searches of :mod:`cartwalk.operators.retrieval`; the plain
inverted-index join on the term (:func:`query_item_cosine`) remains for
selective vocabularies.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cartwalk.functions.exprs import rank_key
from cartwalk.functions.spanish import stem_texts
from cartwalk.functions.stemmer import stem_word
from cartwalk.operators.ids import dense_index, join_small
from cartwalk.operators.retrieval import SHARD_DOCS, cosine_join
from cartwalk.session import bounded_batches, materialize

# Word-token pattern (two or more letters, digits or
# underscores, the vectorizer's default) and thresholds.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
TOKEN_SEPARATOR = r"[^\p{L}\p{N}_]+"
COSINE_THRESHOLD = 0.1
TOP_N = 5
VOCAB_SIZE = 5000
# Descriptive categories in description order (a parameter in the reference).
DESCRIPTIVE = ["product", "colour", "type", "brand"]
NO_RESULT_MESSAGE = "Sin novedades para esta consulta."  # default wording, a parameter of the operators


def spanish_stop_words(spark) -> list[str]:
    from pyspark.ml.feature import StopWordsRemover
    return StopWordsRemover.loadDefaultStopWords("spanish")


# -- T1-T3 --------------------------------------------------------------------

def complete_rows(features: DataFrame) -> DataFrame:
    """E14 / input of T1: rows with both literals."""
    return features.filter(F.col("feature_category_literal").isNotNull()
                           & F.col("feature_value_literal").isNotNull())


def item_descrip(features: DataFrame, categories=DESCRIPTIVE) -> DataFrame:
    """Values of the descriptive categories in category order (then
    value id), joined by spaces, plus `` (item_id)``."""
    order = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("feature_category_literal"))
    c = complete_rows(features)
    items = c.select("item_id").distinct()
    d = (c.filter(order > 0)
         .groupBy("item_id")
         .agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("feature_value_id").alias("p"),
                                                   F.col("feature_value_literal").alias("v")))).alias("vals")))
    return items.join(d, "item_id", "left").select(
        "item_id",
        F.concat(F.coalesce(F.concat_ws(" ", F.col("vals.v")), F.lit("")),
                 F.lit(" ("), F.col("item_id").cast("string"), F.lit(")")).alias("item_descrip"))


def item_keywords(features: DataFrame) -> DataFrame:
    """Distinct values in row order (category id, value id) with the
    item's first category literal removed, joined and lower-cased."""
    c = complete_rows(features).select(
        "item_id", "feature_category_id", "feature_value_id", "feature_category_literal", "feature_value_literal")
    first = c.groupBy("item_id").agg(
        F.min_by("feature_category_literal", F.struct("feature_category_id", "feature_value_id")).alias("cat0"))
    x = c.join(first, "item_id").withColumn(
        "kw", F.when(F.instr("feature_value_literal", F.col("cat0")) > 0,
                     F.replace("feature_value_literal", "cat0", F.lit("")))
        .otherwise(F.col("feature_value_literal")))
    dedup = x.groupBy("item_id", "kw").agg(
        F.min(F.struct("feature_category_id", "feature_value_id")).alias("pos"))
    return dedup.groupBy("item_id").agg(
        F.lower(F.concat_ws(" ", F.sort_array(F.collect_list(F.struct("pos", "kw"))).getField("kw")))
        .alias("item_keywords"))


def collapse_double_spaces(df: DataFrame, col: str) -> DataFrame:
    """Replace two spaces by one in each array element; a non-array
    (null) value gives an empty array."""
    return df.withColumn(col, F.coalesce(F.transform(col, lambda s: F.replace(s, F.lit("  "), F.lit(" "))),
                                         F.array().cast("array<string>")))


# -- T4-T8 --------------------------------------------------------------------

def tokens(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Lower-cased word tokens with their position: (ids..., pos, token).

    Tokens are the maximal runs of letters, digits and underscores of length
    two or more (``TOKEN_PATTERN``); splitting on the complement and dropping
    short pieces gives exactly those runs and is cheaper than extracting
    matches.  Whole texts are tokenised; nothing is truncated."""
    parts = F.split(F.lower(F.col(text_col)), TOKEN_SEPARATOR)
    return (df.select(*id_cols, F.posexplode(F.filter(parts, lambda w: F.length(w) >= 2)).alias("pos", "token")))


def stem_text(df: DataFrame, id_cols: list[str], text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """T4 as text: whitespace split, stem, re-join in order.  With ``lang_col``
    the rules are those of the row's language (English and Spanish; words of other
    languages and of none stay as they are), else the English ones.  Texts without a word give
    no row.  Words are stemmed where a text is read, so nothing is shuffled."""
    bounded_batches(df.sparkSession)
    lang = F.col(lang_col) if lang_col else F.lit("en")
    return df.select(*id_cols, stem_texts(F.lower(F.col(text_col)), lang).alias("stemmed")).filter("stemmed IS NOT NULL")


def remove_stop_words(toks: DataFrame, stop: list[str]) -> DataFrame:
    """T5: drop stop words (anti-join to a fixed-size stop table)."""
    spark = toks.sparkSession
    st = F.broadcast(spark.createDataFrame([(w,) for w in stop], "token STRING"))
    return toks.join(st, "token", "left_anti")


def token_arrays(docs: DataFrame, id_col: str, stop: list[str], text_col: str = "text") -> DataFrame:
    """:func:`tokens` without stop words, a row a document: (id, tokens array<string>); documents without one have no row.

    A text is cut once, and its words stay together where it is read.  Only ids are shuffled, to find documents that stand on several
    rows; these alone are put together."""
    parts = F.split(F.lower(F.col(text_col)), TOKEN_SEPARATOR)
    rows = materialize(docs.select(id_col, F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(list(stop))).alias("tokens"))).filter(F.size("tokens") > 0)
    several = materialize(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(id_col).alias("_id")))
    if several.isEmpty():
        return rows
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    more = rows.join(several, same, "left_semi").groupBy(id_col).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return rows.join(several, same, "left_anti").unionByName(more)


def term_counts(toks: DataFrame, id_cols: list[str]) -> DataFrame:
    return toks.groupBy(*id_cols, "token").agg(F.count(F.lit(1)).alias("tf")).withColumnRenamed("token", "term")


def fit_vocabulary(doc_terms: DataFrame, size: int = VOCAB_SIZE) -> DataFrame:
    """The ``size`` most frequent terms over the corpus (ties by term),
    with their column index in alphabetical order like a count vectorizer."""
    tot = doc_terms.groupBy("term").agg(F.sum("tf").alias("tf"))
    top = tot.orderBy(F.col("tf").desc(), F.col("term")).limit(size)
    return top.withColumn("term_id", (F.row_number().over(Window.orderBy("term")) - 1).cast("long"))


# Words whose stems a Python worker remembers before it starts afresh.
REMEMBERED = 200_000
# Words of texts that are counted at once.
WORDS_AT_ONCE = 500_000
_WORD = re.compile(r"\w{2,}")
_STEMS: dict[str, dict[str, str]] = {}


class _Memo(dict):
    """What ``find`` says of a word, remembered for the first REMEMBERED words."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, word: str):
        said = self.find(word)
        if len(self) < REMEMBERED:
            self[word] = said
        return said


_MEMOS: dict[str, _Memo] = {}


def remembered(key: str, find) -> _Memo:
    """This worker's memo of ``find``, kept from task to task while no other key takes its place.  To be
    imported where it is called: what a task's function brings along is new for each task."""
    if key not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[key] = _Memo(find)
    return _MEMOS[key]


def corpus_counts(docs: DataFrame, stop: list[str], stem: bool = True, text_col: str = "text", stemmer=stem_word) -> DataFrame:
    """:func:`stemmed_counts` of all texts together: (term, tf).  A task adds up words over its texts and
    stems a word when it hands its count on, so what is shuffled follows a task's different words and not its texts."""
    bounded_batches(docs.sparkSession)
    gone, key = frozenset(stop), f"{stemmer.__module__}.{stemmer.__qualname__}"

    def handed(words: Counter) -> pa.RecordBatch:
        from cartwalk.operators.text import remembered
        terms: Counter = Counter()
        stem_of = remembered(key, stemmer) if stem else {w: w for w in words}
        for w, n in words.items():
            terms[stem_of[w]] += n
        kept = [(t, n) for t, n in terms.items() if t not in gone]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["term", "tf"])

    def count(batches):
        words: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    words.update(_WORD.findall(text.lower()))
                if len(words) > REMEMBERED:
                    yield handed(words)
                    words.clear()
        yield handed(words)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term string, tf long").groupBy("term").agg(F.sum("tf").alias("tf"))


def stemmed_counts(docs: DataFrame, id_col: str, stop: list[str], stem: bool = True, text_col: str = "text", stemmer=stem_word) -> DataFrame:
    """(id, term, tf) without stop words: the tokens of
    :func:`tokens`, stemmed by ``stemmer`` (word to word), stop words removed.

    One pass over the texts in Arrow batches: a document's tokens are counted
    where it is read and each worker stems a word once, so only (id, term, tf)
    rows are shuffled, to add up documents that stand on several rows; there is
    no join of occurrences to stems and no hot token.  Null texts have no rows."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, gone, key = to_arrow_type(d.schema["id"].dataType), frozenset(stop), f"{stemmer.__module__}.{stemmer.__qualname__}"

    def count(batches):
        known = _STEMS.setdefault(key, {})
        for b in batches:
            ids, terms, tf = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = Counter(_WORD.findall(text.lower())) if text else {}
                if stem:
                    if len(known) > REMEMBERED:
                        known.clear()
                    words, seen = seen, Counter()
                    for w, n in words.items():
                        s = known.get(w)
                        if s is None:
                            s = known[w] = stemmer(w)
                        seen[s] += n
                kept = [(t, n) for t, n in seen.items() if t not in gone]
                ids += [i] * len(kept)
                terms += [t for t, _ in kept]
                tf += [n for _, n in kept]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=["id", "term", "tf"])

    rows = d.mapInArrow(count, f"id {d.schema['id'].dataType.simpleString()}, term string, tf long")
    return rows.groupBy(F.col("id").alias(id_col), "term").agg(F.sum("tf").alias("tf"))


def packed_vectors(docs: DataFrame, id_col: str, vocab: DataFrame, stop: list[str], stem: bool = False,
                   text_col: str = "text", stemmer=stem_word) -> DataFrame:
    """T7, a row a vector: (id, term_id array<long>, tf array<double>) in the order of terms, stored; texts
    without a word of the vocabulary have no row.

    The vocabulary (a parameter bounds it) goes to the tasks, and a text becomes a vector where it is
    read.  Only ids are shuffled, to find documents that stand on several rows; where there are any, their vectors are
    added up."""
    spark = docs.sparkSession
    bounded_batches(spark)
    gone = frozenset(stop)
    places = {r.term: r.term_id for r in vocab.select("term", "term_id").collect() if r.term not in gone}
    size, key = max(places.values(), default=0) + 1, uuid.uuid4().hex

    def place(word: str) -> int:
        """In the vocabulary; -1 for words whose stem isn't there."""
        return places.get(stemmer(word) if stem else word, -1)

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def pack(batches):
        from cartwalk.operators.text import remembered
        known = remembered(key, place)
        for b in batches:
            found, ends = array("q"), []
            for k in range(b.num_rows):
                if text := b.column(1)[k].as_py():
                    found.extend(map(known.__getitem__, _WORD.findall(text.lower())))
                ends.append(len(found))
                if len(found) < WORDS_AT_ONCE and k + 1 < b.num_rows:
                    continue
                at, first = np.frombuffer(found, np.int64), k + 1 - len(ends)
                doc = np.repeat(np.arange(first, k + 1), np.diff(ends, prepend=0))
                entry, n = np.unique((doc * size + at)[at >= 0], return_counts=True)
                rows, starts = np.unique(entry // size, return_index=True)
                starts = pa.array(np.append(starts, len(entry)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(starts, pa.array(entry % size)),
                                                  pa.ListArray.from_arrays(starts, pa.array(n.astype(np.float64)))], names=["id", "term_id", "tf"])
                found, ends = array("q"), []

    rows = materialize(d.mapInArrow(pack, f"id {d.schema['id'].dataType.simpleString()}, term_id array<long>, tf array<double>"))
    several = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    if several.isEmpty():
        return rows
    same = rows["id"].eqNullSafe(several["id"])
    entries = rows.join(several, same, "left_semi").select("id", F.explode(F.arrays_zip("term_id", "tf")).alias("e"))
    added = entries.groupBy("id", "e.term_id").agg(F.sum("e.tf").alias("tf")).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("term_id", "tf"))).alias("v")).select("id", F.col("v.term_id").alias("term_id"), F.col("v.tf").alias("tf"))
    return materialize(rows.join(several, same, "left_anti").unionByName(added))


def unpacked(vectors: DataFrame, id_col: str, vocab: DataFrame) -> DataFrame:
    """Packed vectors -> (id, term, term_id, tf), a row a term."""
    v = vectors.select(F.col("id").alias(id_col), F.explode(F.arrays_zip("term_id", "tf")).alias("e"))
    return join_small(v.select(id_col, F.col("e.term_id").alias("term_id"), F.col("e.tf").cast("long").alias("tf")), vocab.select("term", "term_id"), "term_id").select(
        id_col, "term", "term_id", "tf")


def doc_vectors(docs: DataFrame, id_col: str, vocab: DataFrame, stop: list[str],
                stem: bool = False, text_col: str = "text") -> DataFrame:
    """(id, term, term_id, tf) restricted to the vocabulary."""
    return unpacked(packed_vectors(docs, id_col, vocab, stop, stem, text_col), id_col, vocab)


def norms(vec: DataFrame, id_col: str) -> DataFrame:
    return vec.groupBy(id_col).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def query_item_cosine(qv: DataFrame, dv: DataFrame, q_id: str = "query_id", d_id: str = "item_id",
                      threshold: float | None = COSINE_THRESHOLD) -> DataFrame:
    """cosine(query, item) over shared terms; strictly above threshold."""
    dot = (qv.select(q_id, "term", F.col("tf").alias("tq"))
           .join(dv.select(d_id, "term", F.col("tf").alias("td")), "term")
           .groupBy(q_id, d_id).agg(F.sum(F.col("tq") * F.col("td")).alias("dot")))
    sim = (dot.join(norms(qv, q_id).withColumnRenamed("norm", "nq"), q_id)
           .join(norms(dv, d_id).withColumnRenamed("norm", "nd"), d_id)
           .select(q_id, d_id, (F.col("dot") / (F.col("nq") * F.col("nd"))).alias("sim")))
    if threshold is not None:
        sim = sim.filter(F.col("sim") > threshold)
    return sim


def top_similar(sim: DataFrame, queries: DataFrame, items: DataFrame, n: int = TOP_N,
                q_id: str = "query_id", d_id: str = "item_id", fill_zero: bool = True) -> DataFrame:
    """The ``n`` most similar items per query (sim desc, item asc);
    with ``fill_zero`` short lists are filled with zero-similarity items in
    ascending id order (the reference's behaviour)."""
    from cartwalk.operators.ranking import fill_from_order
    w = Window.partitionBy(q_id).orderBy(rank_key("sim").desc(), F.col(d_id))
    top = sim.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
    if not fill_zero:
        return top
    top = materialize(top)  # read by the counts, the exclusions and the result
    npos = top.groupBy(q_id).agg(F.count(F.lit(1)).alias("_np"))
    need = queries.select(q_id).distinct().join(npos, q_id, "left").select(
        F.col(q_id).alias("session_id"), F.coalesce("_np", F.lit(0)).alias("_np"),
        (F.lit(n) - F.coalesce("_np", F.lit(0))).alias("need"))
    order = dense_index(items.select(F.col(d_id).alias("item_id")).distinct(), ["item_id"], "pos", start=1)
    blocked = top.select(F.col(q_id).alias("session_id"), F.col(d_id).alias("item_id"))
    fill = fill_from_order(need.select("session_id", "need"), blocked, order)
    fill = fill.join(need.select("session_id", "_np"), "session_id").select(
        F.col("session_id").alias(q_id), F.col("item_id").alias(d_id), F.lit(0.0).alias("sim"),
        (F.col("_np") + F.col("fill_rank")).cast("long").alias("rank"))
    return top.unionByName(fill)


# -- T12 ------------------------------------------------------------------------

def all_pairs_cosine(dv: DataFrame, id_col: str = "item_id", threshold: float = COSINE_THRESHOLD,
                     block_rows: int = SHARD_DOCS, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """T12 as a matrix: cosine of every item pair above ``threshold``
    (diagonal kept, both orders), copies written out.  It expands the class
    rows of :func:`cosine_join`, which large tables should use as they are.
    ``block_rows`` bounds a shard; the index needs no vocabulary size."""
    rows = cosine_join(dv, id_col, threshold, shard_docs=block_rows)
    member = rows.filter(F.col("kind") == "member").select(F.col("item_a").alias("rep"), F.col("item_b").alias("id"))
    pairs = rows.filter(F.col("kind") == "pair").select(F.col("item_a").alias("ra"), F.col("item_b").alias("rb"), "sim")
    pairs = pairs.unionByName(pairs.select(F.col("rb").alias("ra"), F.col("ra").alias("rb"), "sim")) \
        .unionByName(member.filter(F.col("id") == F.col("rep")).select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.lit(1.0).alias("sim")))
    one, two = (member.select(F.col("rep").alias(r), F.col("id").alias(i)) for r, i in (("ra", "item_a"), ("rb", "item_b")))
    return pairs.join(one, "ra").join(two, "rb").select("item_a", "item_b", "sim")


# -- T11, T13 -----------------------------------------------------------------

def encode_query(top: DataFrame, ts: str, q_id: str = "query_id") -> DataFrame:
    """The top items as candidate interactions (session, item, date)."""
    return top.select(F.col(q_id).alias("session_id"), "item_id", "rank",
                      F.lit(ts).cast("timestamp_ntz").alias("date"))


def decode_items(pred: DataFrame, text: DataFrame) -> DataFrame:
    """Attach descriptions (default "") and list them by session in
    rank order."""
    j = pred.join(text.select("item_id", "item_descrip"), "item_id", "left").withColumn(
        "item_descrip", F.coalesce("item_descrip", F.lit("")))
    return j.groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_descrip"))).getField("item_descrip")
        .alias("item_descrip"))
