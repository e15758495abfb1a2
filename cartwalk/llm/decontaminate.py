"""Benchmark decontamination by template canonicalisation.

Built from DataFrame functions only.  Benchmark items and documents are brought
to a canonical form in which numbers, units after numbers and names are typed
placeholders and everything else is lower-case words.  Windows of ``WINDOW``
canonical tokens are hashed and joined.  Matching windows are lined up into
(document, template, offset) alignments, and only windows whose slots are
consistent within their alignment count: equal slots of the item stand opposite
equal values in the document, and different names opposite different names
(different numbers may happen to get the same value).  So a
question asked anew with other numbers and names is caught, while a passage
that merely has the same shape is not.

Beside them go windows of plain lower-case words, numbers and names as they
are, with no literal words required.  They find verbatim copies of items that
are short, dense in numbers, or whose names show differently in the document.

Items are collapsed to templates first: items of the same canonical tokens and
the same pattern of equal slots are one template, so a benchmark of many
variations of one question adds one row to the join, not one for each.

A document is contaminated by a template if consistent alignments, or verbatim
ones, cover ``min(MIN_TOKENS, SHARE of its length)`` of its tokens or more.

Items of fewer than ``MIN_ITEM`` tokens ("Paris", "42") say nothing about a
document that holds them; they take no part and :func:`too_short` lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.llm.common import fresh, quoted, ready, stored

WINDOW = 8
MIN_TOKENS = 13
# Short items need this share of their tokens.
SHARE = 0.8
# A canonical window needs this many words that are no placeholders.
MIN_LITERAL = 4
# Items of fewer words and numbers than this are told apart, not matched.
MIN_ITEM = 4
# Rows of template windows that may be broadcast (three numbers each).
BROADCAST_ROWS = 200_000

# Units of measurement, recognised behind a number only.
UNITS = (
    "mm cm dm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years usd eur dollar dollars cent cents euro euros percent kmh mph kph hz khz mhz ghz "
    "kb mb gb tb w kw kwh v a j kj kcal cal pa bar"
).split()
# Private-use characters stand for the placeholders.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
_NUMBER = r"(?<![\p{L}\p{N}])([+-]?[$€£]?\p{N}+(?:[.,:/]\p{N}+)*)"
_QUANTITY = _NUMBER + r"[ \t]?(%|(?i:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{N}]))"
_NAME = r"(?<=[^.!?:;\s\p{Co}][ \t])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
_SPLIT = r"[^\p{L}\p{N}\ue000-\ue002]+"
_WORD_SPLIT = r"[^\p{L}\p{N}]+"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\ue000-\ue002]", " ")


def canonical(text: Column) -> Column:
    """Array of canonical tokens: lower-case words and placeholders.  Names
    are capitalised words that don't open a sentence or line."""
    t = F.regexp_replace(_plain(text), _NAME, f" {NAME} ")
    t = F.regexp_replace(t, _QUANTITY, f" {NUMBER} {UNIT} ")
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER} ")
    return F.filter(F.split(F.lower(t), _SPLIT), lambda x: x != "")


def verbatim(text: Column) -> Column:
    """Array of lower-case words and numbers as they stand in the text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORD_SPLIT), lambda x: x != "")


def _wanted(n: str) -> Column:
    return F.least(F.lit(MIN_TOKENS), F.ceil(F.lit(SHARE) * F.col(n)))


def slot_values(text: Column) -> Column:
    """Values of the slots of each type in text order."""
    t = F.regexp_replace(_plain(text), _NAME, f" {NAME} ")
    return F.struct(F.regexp_extract_all(_plain(text), F.lit("(" + _NAME + ")"), F.lit(1)).alias("names"),
                    F.regexp_extract_all(t, F.lit(_NUMBER), F.lit(1)).alias("numbers"),
                    F.regexp_extract_all(F.lower(t), F.lit(_QUANTITY), F.lit(2)).alias("units"))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _opposite(tokens: Column, values: Column) -> Column:
    """For each token its slot value, prefixed by the type; null for words."""
    def one(mark, what):
        at = F.filter(F.transform(tokens, lambda x, i: F.when(x == mark, i)), lambda x: x.isNotNull())
        return F.map_from_arrays(F.slice(at, 1, F.least(F.size(at), F.size(values[what]))),
                                 F.slice(values[what], 1, F.least(F.size(at), F.size(values[what]))))
    kinds = {"names": NAME, "numbers": NUMBER, "units": UNIT}
    return _bound(F.struct(*[one(mark, what).alias(what) for what, mark in kinds.items()]), lambda m: F.transform(
        tokens, lambda x, i: F.coalesce(*[F.when(x == mark, F.concat(F.lit(mark), F.coalesce(F.element_at(m[what], i), F.lit(""))))
                                          for what, mark in kinds.items()])))


def _doubled(values: Column, sizes: list[int], body, then) -> Column:
    """``then`` of arrays that put together, for each of ``sizes``, so many neighbouring
    ``values`` by ``body(left, right)``.  They are made of spans of 1, 2, 4, ... values, so
    a step is needed for each doubling and not for each value; null where there are too few."""
    def beside(left, right, shift):
        n = F.size(right) - shift
        return F.when(n > 0, F.zip_with(F.slice(left, 1, F.greatest(n, F.lit(0))), F.slice(right, shift + 1, F.greatest(n, F.lit(0))), body))

    def of(k, spans):
        have, length = None, 0
        for size in sorted(spans, reverse=True):
            if k & size:
                have = spans[size] if have is None else beside(have, spans[size], length)
                length += size
        return have

    def grown(spans, size):
        if size * 2 > max(sizes):
            return then([of(k, spans) for k in sizes])
        return _bound(beside(spans[size], spans[size], size), lambda wider: grown({**spans, size * 2: wider}, size * 2))
    return _bound(values, lambda single: grown({1: single}, 1))


def _windows(tokens: Column, sizes: list[int], plain: bool = False) -> Column:
    """Array of (hash, pos) of all windows; canonical ones need enough literal
    words.  Hashes of plain and canonical windows and of sizes are told apart."""
    none = F.array().cast("array<struct<h:bigint,pos:int>>")

    def hashes(values, then):
        return _doubled(F.transform(values, lambda x: F.xxhash64(x)), sizes, lambda x, y: F.xxhash64(x, y), then)
    if plain:
        return hashes(tokens, lambda by_size: F.concat(*[F.coalesce(F.transform(h, lambda x, i: F.struct(
            F.xxhash64(F.lit(-k), x).alias("h"), i.alias("pos"))), none) for k, h in zip(sizes, by_size)]))

    def listed(k, h):
        return lambda counts: F.filter(F.transform(h, lambda x, i: F.when(F.get(counts, i) >= MIN_LITERAL, F.struct(
            F.xxhash64(F.lit(k), x).alias("h"), i.alias("pos")))), lambda w: w.isNotNull())

    def literal(values, then):
        return _doubled(F.transform(values, lambda x: F.when(x.isin(NUMBER, UNIT, NAME), 0).otherwise(1)), sizes, lambda x, y: x + y, then)
    return _bound(tokens, lambda values: hashes(values, lambda by_size: literal(values, lambda counts: F.concat(*[F.coalesce(
        _bound(n, listed(k, h)), none) for k, h, n in zip(sizes, by_size, counts)]))))


def _conflicts(slots: DataFrame, by: list[str]) -> DataFrame:
    """Positions of the slots at odds with their alignment: ``slots`` (the
    columns ``by`` of an alignment, p, s, v) -> by, bad (array of p).  A pair of a slot and a
    value is at odds if the slot has another value at least as often, or if
    the value is a name that another slot has too."""
    def over(*cols):
        return Window.partitionBy(*by, *cols)
    # One shuffle by alignment; it serves the counts and both windows.
    pairs = slots.filter("v IS NOT NULL").repartition(*by).groupBy(*by, "s", "v").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list("p").alias("ps"))
    pairs = pairs.withColumn("top", F.max("n").over(over("s"))).withColumn(
        "tops", F.sum(F.when(F.col("n") == F.col("top"), 1).otherwise(0)).over(over("s"))).withColumn(
        "shared", F.col("v").startswith(NAME) & (F.count(F.lit(1)).over(over("v")) > 1))
    return pairs.filter("shared OR n < top OR tops > 1").groupBy(*by).agg(F.flatten(F.collect_list("ps")).alias("bad"))


def _items(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items that have tokens: item_id, tokens, pattern, key of the template
    and words (plain tokens)."""
    def numbered(values):
        return F.transform(values, lambda v: F.when(v.isNull(), F.lit(-1)).otherwise(
            F.array_position(F.filter(values, lambda x: x.isNotNull()), v).cast("int")))
    items = bench.select(quoted(id_col).alias("item_id"), canonical(quoted(text_col)).alias("tokens"),
                         slot_values(quoted(text_col)).alias("v"), verbatim(quoted(text_col)).alias("words"))
    items = items.filter(F.size("tokens") > 0).select("item_id", "tokens", _opposite(F.col("tokens"), F.col("v")).alias("values"), "words")
    return items.withColumn("pattern", numbered(F.col("values"))).withColumn("key", F.xxhash64("tokens", "pattern"))


def templates(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Benchmark items collapsed to templates: template_id (smallest item id),
    tokens, n_tokens, pattern (for each token the number of its slot value, -1
    for words) and n_items.  Items without tokens are left out; null ids take
    part but name a template only where no other item shares it."""
    return _items(bench, id_col, text_col).groupBy("tokens", "pattern").agg(
        F.min("item_id").alias("template_id"), F.count(F.lit(1)).alias("n_items"), F.first("key").alias("key")).withColumn(
        "n_tokens", F.size("tokens"))


def _own_windows(rows: DataFrame, tokens: str, plain: bool) -> tuple[DataFrame, list[int]]:
    """Windows of the benchmark side (rows: key, n, tokens), each of the one
    size its length asks for, and the sizes there are (MIN_ITEM..WINDOW)."""
    rows, k = rows.filter(F.col("n") >= MIN_ITEM), F.least("n", F.lit(WINDOW))
    sizes = sorted(r["k"] for r in rows.select(k.alias("k")).distinct().collect())
    parts = [rows.filter(k == s).select("key", "n", F.lit(s).alias("k"), F.lit(plain).alias("plain"), F.explode(
        _windows(F.col(tokens), [s], plain)).alias("w")) for s in sizes or [WINDOW]]
    own = parts[0]
    for part in parts[1:]:
        own = own.unionByName(part)
    return own.select("key", "n", "k", "plain", F.col("w.h").alias("h"), F.col("w.pos").alias("tpos")).distinct(), sizes


def too_short(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Items that :func:`hits` never reports, as they have fewer than
    ``MIN_ITEM`` words and numbers: item_id, n_words.  Null and empty texts
    have 0; null ids and repeated rows are listed as they are."""
    n = F.size(verbatim(quoted(text_col)))
    return bench.select(quoted(id_col).alias("item_id"), n.cast("long").alias("n_words")).filter(F.col("n_words") < MIN_ITEM)


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and template that contaminates it: doc_id,
    item_id (the template's smallest), n_items of the template, n_tokens of it,
    covered (tokens under consistent alignments, or under verbatim ones if
    these are more) and n_slots (most slots that one consistent alignment covers).

    Null and empty texts match nothing.  Rows that share a document id are
    taken as parts of one document; rows with a null id never match.  An empty
    table on either side gives an empty result.  Items listed by
    :func:`too_short` match nothing.
    """
    text = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).filter("doc_id IS NOT NULL")
    return _hits(text, bench).withColumnRenamed("doc_id", id_col)


def _hits(text: DataFrame, bench: DataFrame) -> DataFrame:
    """:func:`hits` of ``text`` (doc_id, text), no id null."""
    ready(text.sparkSession)
    known = stored(templates(bench).select("template_id", "key", "tokens", "pattern", "n_items", "n_tokens"))
    # Variations of a template that are equally long share their plain windows.
    words = stored(_items(bench, "item_id", "text").select("key", "words", F.size("words").alias("n")))
    own, sizes = _own_windows(known.select("key", "tokens", F.col("n_tokens").alias("n")), "tokens", False)
    own_plain, plain_sizes = _own_windows(words, "words", True)
    own = stored(own.unionByName(own_plain))
    side = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    seen = text.select("doc_id", F.explode(F.concat(
        _windows(canonical(F.col("text")), sizes or [WINDOW]), _windows(verbatim(F.col("text")), plain_sizes or [WINDOW], True))).alias("w")).select(
        "doc_id", F.col("w.h").alias("h"), F.col("w.pos").alias("pos"))
    found = stored(seen.join(side, "h").groupBy("doc_id", "key", "plain", "n", (F.col("pos") - F.col("tpos")).alias("shift")).agg(
        F.collect_set("tpos").alias("at"), F.min("k").alias("k")))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("k") - 1))))
    found = found.withColumn("covered", covered)
    union = F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("covered")
    copied = found.filter("plain").groupBy("doc_id", "key", "n").agg(union).filter(F.col("covered") >= _wanted("n")).select(
        "doc_id", "key", "covered", F.lit(0).alias("n_slots"))

    # Slots are looked up in the documents that matched, and nowhere else.
    found = found.filter("NOT plain")
    matched = found.select("doc_id").distinct()
    opposite = text.join(matched, "doc_id").select("doc_id", canonical(F.col("text")).alias("tokens"), slot_values(F.col("text")).alias("v")).select(
        "doc_id", _opposite(F.col("tokens"), F.col("v")).alias("values"))
    lined = stored(found.join(known, "key").join(opposite, "doc_id").select("doc_id", "key", "n", "shift", "at", "k", F.filter(
        F.transform("covered", lambda p: F.struct(p.alias("p"), F.get("pattern", p).alias("s"), F.get("values", p + F.col("shift")).alias("v"))),
        lambda x: x["s"] >= 0).alias("pairs")))
    # Only the windows over a conflicting slot go, not the whole alignment.
    by = ["doc_id", "key", "shift"]
    bad = _conflicts(lined.select(*by, F.inline("pairs")), by)
    over_bad = F.flatten(F.transform("bad", lambda p: F.sequence(p - F.col("k") + 1, p)))
    lined = lined.join(bad, by, "left").withColumn("at", F.when(F.col("bad").isNull(), F.col("at")).otherwise(
        F.array_except("at", over_bad)))
    lined = lined.withColumn("covered", covered).withColumn(
        "slots", F.size(F.array_intersect(F.transform("pairs", lambda x: x["p"]), "covered")))
    varied = lined.groupBy("doc_id", "key", "n").agg(union, F.max("slots").alias("n_slots")).filter(
        F.col("covered") >= _wanted("n")).select("doc_id", "key", "covered", "n_slots")
    return copied.unionByName(varied).groupBy("doc_id", "key").agg(F.max("covered").alias("covered"), F.max("n_slots").alias("n_slots")).join(
        known, "key").select("doc_id", F.col("template_id").alias("item_id"), "n_items", "n_tokens", "covered", "n_slots")


def keep_clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               match_null_ids: bool = False) -> DataFrame:
    """``docs`` without the documents any benchmark item contaminates.  Rows
    with a null id are kept, or, with ``match_null_ids``, are documents of
    their own, told apart by a stored row key."""
    if not match_null_ids:
        bad = stored(hits(docs, bench, id_col, text_col).select(quoted(id_col).alias("_bad")).distinct())
        return docs.join(bad, quoted(id_col) == F.col("_bad"), "left_anti")
    row = fresh("_row", docs)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    # Not null in either field, so that keys can be compared by equality.
    key = F.struct(quoted(id_col).isNull().alias("none"), F.coalesce(quoted(id_col).cast("string"), F.col(row).cast("string")).alias("id"))
    bad = stored(_hits(rows.select(key.alias("doc_id"), quoted(text_col).alias("text")), bench).select("doc_id").distinct())
    gone = rows.select(F.col(row).alias("_gone"), key.alias("_key")).join(bad, F.col("_key") == F.col("doc_id")).select("_gone")
    return rows.join(gone, F.col(row) == F.col("_gone"), "left_anti").select(*[quoted(c) for c in docs.columns])
