"""Spanish suffix stemmer with regions, after the published description of the
Snowball algorithm for Spanish (M. F. Porter and others).

``RV``, ``R1`` and ``R2`` are tails of the word; a suffix goes only where it lies
in the tail its rule names.  Words are lower case and precomposed (NFC).  An alternation
anchored at the end finds the longest of several suffixes, since a search
takes the leftmost match; the SQL form uses the same patterns.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwalk.functions.stemmer import stem_word

# Vowels and suffixes of the published algorithm.
VOWELS = "aeiouáéíóúü"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos"
ACCENTED = "iéndo ándo ár ér ír"
VERB_FORMS = "ando iendo ar er ir"
PLAIN = ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas "
         "amiento amientos imiento imientos")
AGENT = "adora ador ación adoras adores aciones ante antes ancia ancias"
LOGIA = "logía logías"
UCION = "ución uciones"
ENCIA = "encia encias"
IDAD = "idad idades"
IVA = "iva ivo ivas ivos"
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
GU_VERBS = "en es éis emos"
VERBS = ("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis "
         "eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara "
         "iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er "
         "ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis "
         "ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos")
RESIDUAL = "os a o á í ó"
RESIDUAL_E = "e é"


def _ends(*lists: str) -> str:
    """Pattern for the longest of the listed suffixes."""
    return "(" + "|".join(" ".join(lists).split()) + ")$"


V, C = f"[{VOWELS}]", f"[^{VOWELS}]"
REGION = f"{V}{C}"  # R1 begins behind the first of these, R2 behind the first one in R1
RV_HEAD = f"^(.{C}{C}*{V}|{V}{V}{V}*{C}|{C}{V}.)"
PRONOUN = _ends(PRONOUNS)
BEFORE_PRONOUN = _ends(ACCENTED, VERB_FORMS, "yendo")
STEP1 = _ends(PLAIN, AGENT, LOGIA, UCION, ENCIA, "amente mente", IDAD, IVA)
# What may go with a removed suffix, where it lies in R2 too.
ALSO = {"agent": "(ic)$", "amente": "(iv|os|ic|ad)$", "mente": "(ante|able|ible)$", "idad": "(abil|ic|iv)$", "iva": "(at)$"}
STEP2A, STEP2B, STEP3 = _ends(Y_VERBS), _ends(GU_VERBS, VERBS), _ends(RESIDUAL, RESIDUAL_E)
FROM, TO = "áéíóú", "aeiou"
_PLAIN_VOWELS = str.maketrans(FROM, TO)


def _tail(pattern: str, w: str, start: int = 0) -> int:
    m = re.compile(pattern, re.S).search(w, start)
    return m.end() if m else len(w)


def _suffix(pattern: str, w: str) -> str:
    m = re.search(pattern, w)
    return m.group(1) if m else ""


def _drop(w: str, suffix: str) -> str:
    return w[:len(w) - len(suffix)]


def _step1(w: str, r1: int, r2: int) -> str:
    s = _suffix(STEP1, w)
    stem = _drop(w, s)
    if not s or len(stem) < (r1 if s == "amente" else r2):
        return w
    if s in LOGIA.split():
        return stem + "log"
    if s in UCION.split():
        return stem + "u"
    if s in ENCIA.split():
        return stem + "ente"
    kind = next((k for k, v in (("agent", AGENT), ("amente", "amente"), ("mente", "mente"), ("idad", IDAD), ("iva", IVA))
                 if s in v.split()), None)
    more = _suffix(ALSO[kind], stem) if kind else ""
    if more and len(stem) - len(more) >= r2:
        stem = _drop(stem, more)
        if kind == "amente" and more == "iv" and stem.endswith("at") and len(stem) - 2 >= r2:
            stem = stem[:-2]
    return stem


def stem_spanish(w: str | None) -> str | None:
    """Stem of one lower-case word; null stays null."""
    if w is None:
        return None
    r1 = _tail(REGION, w)
    r2, rv = _tail(REGION, w, r1), _tail(RV_HEAD, w)
    # attached pronoun
    p = _suffix(PRONOUN, w)
    verb = _suffix(BEFORE_PRONOUN, _drop(w, p)) if p else ""
    if verb and len(w) - len(p) - len(verb) >= rv:
        stem = _drop(w, p)
        if verb in ACCENTED.split():
            w = _drop(stem, verb) + verb.translate(_PLAIN_VOWELS)
        elif verb != "yendo" or _drop(stem, verb).endswith("u"):
            w = stem
    before = w
    w = _step1(w, r1, r2)
    if w == before:
        s = _suffix(STEP2A, w[rv:])
        if s and _drop(w, s).endswith("u"):
            w = _drop(w, s)
        else:
            s = _suffix(STEP2B, w[rv:])
            w = _drop(w, s)
            if s in GU_VERBS.split() and w.endswith("gu"):
                w = w[:-1]
    s = _suffix(STEP3, w[rv:])
    w = _drop(w, s)
    if s in RESIDUAL_E.split() and w.endswith("gu") and len(w) - 1 >= rv:
        w = w[:-1]
    return w.translate(_PLAIN_VOWELS)


STEMMERS = {"en": stem_word, "es": stem_spanish}


SPACE = re.compile(r"\s+", re.ASCII)
# Stems a worker remembers: this many words of at most this many letters a language.
MEMO, MEMO_LETTERS = 1 << 17, 64


@lru_cache(maxsize=len(STEMMERS))
def _remembering(lang: str):
    stem = STEMMERS[lang]
    known = lru_cache(maxsize=MEMO)(stem)
    return lambda w: known(w) if len(w) <= MEMO_LETTERS else stem(w)


@F.pandas_udf(T.StringType())
def stem_texts(texts: pd.Series, lang: pd.Series) -> pd.Series:
    """Whole lower-case texts with every word (a whitespace split) stemmed by the
    rules of the row's language, joined by one space; languages without rules here,
    and null, leave words as they are.  Null and a text without a word give null."""
    out = []
    for text, g in zip(texts, lang):
        words = [w for w in SPACE.split(text) if w] if text else []
        if g in STEMMERS:
            words = map(_remembering(g), words)
        out.append(" ".join(words) or None)
    return pd.Series(out, dtype=object)


def stem_spanish_sql(tokens: str) -> str:
    """The same rules as SQL for oracles: CTEs ending in ``es_stems`` (token,
    stem) for the distinct values of the CTE ``tokens`` (token)."""
    def tail(x: str, pattern: str) -> str:
        # length of the tail behind the first match, none without a match
        return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN length(regexp_replace({x}, '^.*?{pattern.lstrip('^')}', '', 's')) ELSE 0 END"

    def end(x: str, pattern: str) -> str:
        return f"regexp_extract({x}, '{pattern}', 1)"

    def cut(x: str, suffix: str) -> str:
        return f"left({x}, length({x}) - length({suffix}))"

    def among(x: str, words: str) -> str:
        return f"{x} IN ({', '.join(repr(v) for v in words.split())})"
    # r1, r2 and rv are counted from the word's start
    return f"""es_0 AS (SELECT DISTINCT token, token AS w FROM {tokens}),
es_1 AS (SELECT *, length(w) - {tail('w', REGION)} AS r1, length(w) - {tail('w', RV_HEAD)} AS rv, {end('w', PRONOUN)} AS p FROM es_0),
es_2 AS (SELECT *, length(w) - {tail("substring(w, r1 + 1)", REGION)} AS r2, {cut('w', 'p')} AS s,
  CASE WHEN p <> '' THEN {end(cut('w', 'p'), BEFORE_PRONOUN)} ELSE '' END AS verb FROM es_1),
es_3 AS (SELECT token, r1, r2, rv, CASE
  WHEN verb = '' OR length(s) - length(verb) < rv THEN w
  WHEN {among('verb', ACCENTED)} THEN {cut('s', 'verb')} || translate(verb, '{FROM}', '{TO}')
  WHEN verb = 'yendo' AND NOT ends_with({cut('s', 'verb')}, 'u') THEN w ELSE s END AS w FROM es_2),
es_4 AS (SELECT *, {end('w', STEP1)} AS p, {cut('w', end('w', STEP1))} AS s FROM es_3),
es_5 AS (SELECT *, p <> '' AND length(s) >= CASE WHEN p = 'amente' THEN r1 ELSE r2 END AS hit, CASE
  WHEN {among('p', AGENT)} THEN {end('s', ALSO['agent'])} WHEN p = 'amente' THEN {end('s', ALSO['amente'])}
  WHEN p = 'mente' THEN {end('s', ALSO['mente'])} WHEN {among('p', IDAD)} THEN {end('s', ALSO['idad'])}
  WHEN {among('p', IVA)} THEN {end('s', ALSO['iva'])} ELSE '' END AS more FROM es_4),
es_6 AS (SELECT *, CASE WHEN length(s) - length(more) >= r2 THEN {cut('s', 'more')} ELSE s END AS t FROM es_5),
es_7 AS (SELECT token, rv, hit, w AS w0, CASE WHEN NOT hit THEN w
  WHEN {among('p', LOGIA)} THEN s || 'log' WHEN {among('p', UCION)} THEN s || 'u' WHEN {among('p', ENCIA)} THEN s || 'ente'
  WHEN p = 'amente' AND more = 'iv' AND t <> s AND ends_with(t, 'at') AND length(t) - 2 >= r2 THEN left(t, length(t) - 2)
  ELSE t END AS w FROM es_6),
es_8 AS (SELECT token, rv, w, w <> w0 AS done, {end('substring(w, rv + 1)', STEP2A)} AS ya, {end('substring(w, rv + 1)', STEP2B)} AS verb FROM es_7),
es_9 AS (SELECT token, rv, CASE WHEN done THEN w WHEN ya <> '' AND ends_with({cut('w', 'ya')}, 'u') THEN {cut('w', 'ya')}
  WHEN {among('verb', GU_VERBS)} AND ends_with({cut('w', 'verb')}, 'gu') THEN left(w, length(w) - length(verb) - 1)
  ELSE {cut('w', 'verb')} END AS w FROM es_8),
es_10 AS (SELECT token, rv, {end('substring(w, rv + 1)', STEP3)} AS p, {cut('w', end('substring(w, rv + 1)', STEP3))} AS w FROM es_9),
es_stems AS (SELECT token, translate(CASE WHEN {among('p', RESIDUAL_E)} AND ends_with(w, 'gu') AND length(w) - 1 >= rv
  THEN left(w, length(w) - 1) ELSE w END, '{FROM}', '{TO}') AS stem FROM es_10)"""
