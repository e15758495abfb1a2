"""The Spanish stemmer: published examples, and its SQL form word by word."""

import duckdb
import pytest

from cartwalk.functions.spanish import GU_VERBS, PRONOUNS, STEP1, VERBS, Y_VERBS, stem_spanish, stem_spanish_sql
from cartwalk.operators import text as TX

# Examples published with the algorithm.
EXAMPLES = dict(p.split(":") for p in """
cheque:chequ cheques:chequ cheyene:cheyen chi:chi chía:chi chiapaneca:chiapanec chiapas:chiap chiba:chib chic:chic
chica:chic chicago:chicag chicana:chican chicano:chican chicas:chic chicharrones:chicharron chichen:chich
chichimecas:chichimec chicles:chicl chico:chic tórax:torax torcer:torc toreado:tor toreados:tor toreándolo:tor
torear:tor toreara:tor torearlo:tor toreó:tore torero:torer toreros:torer torio:tori tormenta:torment
tormentas:torment tornado:torn tornados:torn tornar:torn tornen:torn torneo:torne torneos:torne tornillo:tornill
tornillos:tornill torniquete:torniquet torno:torn toro:tor toronto:toront toros:tor torpedearon:torped
torpeza:torpez torrado:torr torralba:torralb torre:torr torrencial:torrencial torrenciales:torrencial
torrente:torrent torreon:torreon torreón:torreon torres:torr torrescano:torrescan
""".split())


@pytest.mark.parametrize("word,stem", EXAMPLES.items())
def test_published_examples(word, stem):
    assert stem_spanish(word) == stem


def test_sql_form_agrees():
    heads = ["", "a", "o", "tor", "aé", "oí", "contribu", "averigu", "segu", "nacionaliz", "product", "psicol",
             "evolu", "relativ", "generos", "constitu", "comunic", "posibil", "abil", "creat", "hü", "x3", "día"]
    ends = set(f"{STEP1[1:-2].replace('|', ' ')} {PRONOUNS} {Y_VERBS} {GU_VERBS} {VERBS} e é os a guen gué".split())
    words = sorted({h + e for h in heads for e in ends} | {h + v + p for h in heads for v in ("ándo", "iéndo", "ar", "yendo")
                                                          for p in PRONOUNS.split()} | set(EXAMPLES) | {"", "ñ", "a\nb"})
    con = duckdb.connect()
    con.execute("CREATE TABLE t (token VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(w,) for w in words])
    got = dict(con.execute(f"WITH {stem_spanish_sql('t')} SELECT token, stem FROM es_stems").fetchall())
    assert len(got) == len(words)
    assert {w: s for w, s in got.items() if s != stem_spanish(w)} == {}


def test_language_column(spark):
    rows = [(1, "es", "las tormentas torrenciales"), (2, "en", "falling ponies"), (3, "fr", "les chevaux"), (4, None, "cats"),
            (5, "es", None), (6, "es", "  ")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r.stemmed for r in TX.stem_text(df, ["doc_id"], lang_col="lang").collect()}
    assert got == {1: "las torment torrencial", 2: "fall poni", 3: "les chevaux", 4: "cats"}
