"""Display names out of official ones: title case, accents restored from known spellings, damage of exports mended, street labels.

Every distinct name is taken apart once; words meet the known spellings in a join, so neither table has to be small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, without_marks
from .catalogue import spellings

# fixed values: words that stay small after the first one, and those of them that are single letters
PARTICLES = ("de", "del", "la", "las", "los", "el", "y", "e", "o", "u", "a", "en", "al", "con", "por", "para", "sin")
LETTERS = ("e", "o", "u", "a")
# fixed values: words that never take an accent
UNACCENTED = (
    "de", "el", "la", "las", "los", "del", "y", "e", "o", "u", "a", "en", "al", "mi", "tu", "te",
    "se", "si", "mas", "solo", "aun", "este", "ese", "esta", "esa", "pena", "nina", "ano", "papa",
    "mama", "oscar",
)
# fixed values: words of two letters; others of that length are codes
SHORT_WORDS = (
    "de", "la", "el", "en", "al", "lo", "le", "se", "su", "tu", "mi", "ya", "si", "yo", "un", "va",
    "da", "ve", "ni", "os", "ex", "fe", "ti", "oe", "no", "sn",
)
# fixed values: abbreviations, and those that need no dot to be one
ABBREVIATIONS = {
    "av": "Av.", "avda": "Av.", "cl": "C.", "cll": "C.", "psje": "Pje.", "pje": "Pje.", "cjon": "Cjón.",
    "cj": "Cjón.", "pse": "Paseo", "peat": "Peatonal", "tvl": "Transversal", "dgl": "Diagonal",
    "rto": "Retorno", "herr": "Herradura", "esc": "Escalinata", "blvd": "Blvd.", "blvr": "Blvd.",
    "dr": "Dr.", "dra": "Dra.", "gral": "Gral.", "crnel": "Crnel.", "cnel": "Cnel.", "sgto": "Sgto.",
    "tnte": "Tnte.", "tte": "Tte.", "cap": "Cap.", "cpt": "Cap.", "ing": "Ing.", "arq": "Arq.",
    "ab": "Ab.", "abg": "Abg.", "lcdo": "Lcdo.", "lcda": "Lcda.", "lic": "Lic.", "prof": "Prof.",
    "sta": "Sta.", "sto": "Sto.", "sn": "San", "mons": "Mons.", "pbro": "Pbro.", "fr": "Fr.",
    "cdla": "Cdla.", "coop": "Coop.", "urb": "Urb.", "mz": "Mz.", "km": "km", "nro": "N.º",
    "no": "N.º", "gob": "Gob.", "mcal": "Mcal.", "alm": "Alm.", "pdte": "Pdte.", "hno": "Hno.",
}
UNDOTTED = ("av", "cdla", "coop", "psje", "cjon")
# fixed values: shapes of words
AROUND = "^([\"'(\\[¿¡]*)(.*?)([\"'),.;:\\]?!]*)$"
ORDINAL = "(?i)^(\\d+)(er|ero|era|ro|ra|do|da|to|ta|mo|ma|vo|va|no|na|avo|ava|°|º)\\.?$"
CODE = "^(?=.*\\d)[0-9A-Za-z]+(?:[-/][0-9A-Za-z]+)*$|^[A-Za-z]{1,2}(?:-[0-9A-Za-z]+)+$"
DIRECTION = "(?i)^(?:N|S|E|O|NE|NO|SE|SO|N-E|N-O|S-E|S-O)$"
# fixed values: what a street's kind puts before its name, and words that already say the kind
PREFIXES = {
    "AVENIDA": "Av.", "CALLE": "C.", "PASAJE": "Pje.", "CALLEJON": "Callejón", "PEATONAL": "Peatonal", "SENDERO": "Sendero",
    "ESCALINATA": "Escalinata", "PASEO": "Paseo", "PANAMERICANA": "Panamericana", "CARRETERA": "Carretera", "AUTOPISTA": "Autopista",
    "TRANSVERSAL": "Transversal", "REDONDEL": "Redondel", "DIAGONAL": "Diagonal", "CAMINO": "Camino", "RETORNO": "Retorno",
    "CIRCUNVALACION": "Circunvalación", "HERRADURA": "Herradura", "VIA": "Vía", "TUNEL": "Túnel", "LINEA FERREA": "Línea férrea",
}
KIND_WORDS = (
    "AV", "AVDA", "AVENIDA", "CL", "CALLE", "PSJE", "PJE", "PASAJE", "CJON", "CJ", "CALLEJON", "PEAT", "PEATONAL", "PSE", "PASEO",
    "TVL", "TRANSVERSAL", "DGL", "DIAGONAL", "RTO", "RETORNO", "HERR", "HERRADURA", "ESC", "ESCALINATA", "SENDERO", "MALECON", "BLVD", "BLVR",
    "BOULEVARD", "BULEVAR", "VIA", "AUTOPISTA", "CARRETERA", "PANAMERICANA", "CIRCUNVALACION", "PERIMETRAL", "CAMINO", "REDONDEL",
    "TUNEL", "PUENTE", "VIADUCTO", "ACCESO", "RAMAL", "EJE", "PASO", "INTERCAMBIADOR", "SUBIDA", "BAJADA", "ENTRADA", "CARRERA",
)
LOST = "�"  # a character that an export could not write
LOSABLE = "ÑÁÉÍÓÚÜ"  # fixed value: what it may have been, in the order tried


def plain(word: Column) -> Column:
    """The word as known spellings are looked up by."""
    return without_marks(F.lower(word), "NFKD")


def known_spellings(names: DataFrame, curated: DataFrame | None = None, least: int = 2) -> DataFrame:
    """word, spelling: the spellings of curated (column spelling), and for other words what names show `least` times."""
    learned = spellings(names, least).filter(~F.col("word").isin(*UNACCENTED)).select("word", "spelling")
    if curated is None:
        return learned
    mine = curated.select(plain(F.col("spelling")).alias("word"), F.lower("spelling").alias("spelling")).groupBy("word").agg(F.min("spelling").alias("spelling"))
    return mine.unionByName(learned.join(mine, "word", "left_anti"))


def first_known(tried: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """key and what, spelling of the first of its tries (array of attempt, what) that is a known word."""
    t = tried.select(key, F.posexplode("tries").alias("n", "t")).select(key, "n", F.col("t.what").alias("what"), plain(F.col("t.attempt")).alias("folded"))
    hit = t.join(known.select(F.col("word").alias("folded"), "spelling"), "folded").groupBy(key).agg(F.min(F.struct("n", "what", "spelling")).alias("b"))
    return hit.select(key, "b.what", "b.spelling")


def mended(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, text: a lost character becomes the first letter that makes a known word, else ñ between vowels, else nothing; after a digit a degree sign."""
    around = "\\p{L}*" + LOST + "\\p{L}*"
    whole = names.filter(~F.col("name").contains(LOST)).select("name", F.col("name").alias("text"))
    t = names.filter(F.col("name").contains(LOST)).select("name", F.regexp_replace("name", "(\\d)" + LOST, "$1°").alias("t"))
    t = t.select("name", F.split("t", around, -1).alias("gaps"), F.regexp_extract_all("t", F.lit(around), F.lit(0)).alias("spans"))
    filled = lambda c: F.replace(F.col("span"), F.lit(LOST), F.lit(c))
    spans = t.select(F.explode("spans").alias("span")).distinct()
    tries = F.array(*[F.struct(filled(c).alias("attempt"), F.lit(c).alias("what")) for c in LOSABLE])
    best = first_known(spans.withColumn("tries", tries), "span", known).select("span", "what")
    guess = F.when(F.col("span").rlike(f"(?i)[aeiou]{LOST}[aeiou]"), "Ñ").otherwise("")
    put = t.select("name", F.posexplode("spans").alias("i", "span")).join(best, "span", "left")
    put = put.select("name", "i", F.replace("span", F.lit(LOST), F.coalesce("what", guess)).alias("s"))
    put = put.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"))
    both = F.zip_with("gaps", "s", lambda g, s: F.concat(g, F.coalesce(s["s"], F.lit(""))))
    return whole.unionByName(t.join(put, "name", "left").select("name", F.array_join(F.when(F.col("s").isNull(), F.col("gaps")).otherwise(both), "").alias("text")))


def judged(words: Column) -> Column:
    """head, core, tail, first and fixed of words (raw, first, prev): fixed is how the word is shown, null where it has to be spelled."""
    part = lambda x, i: F.regexp_extract(x["raw"], AROUND, i)
    coded = lambda p: (p != "") & (p.rlike("\\p{Nd}") | (F.length(F.regexp_replace(p, "^\\.+|\\.+$", "")) <= 2))
    cut = F.transform(words, lambda x: F.struct(x["raw"].alias("raw"), part(x, 1).alias("head"), part(x, 2).alias("core"), part(x, 3).alias("tail"), x["first"].alias("first"), coded(x["prev"]).alias("coded")))
    low = F.transform(cut, lambda x: F.struct(x["raw"].alias("raw"), x["head"].alias("head"), x["core"].alias("core"), x["tail"].alias("tail"), x["first"].alias("first"), x["coded"].alias("coded"), F.lower(x["core"]).alias("low")))
    short = F.create_map(*[F.lit(v) for p in ABBREVIATIONS.items() for v in p])

    def shown(x: Column) -> Column:
        core, w, n = x["core"], x["low"], F.length(x["core"])
        ending = F.regexp_extract(core, ORDINAL, 2)
        return (
            F.when(core == "", "")
            .when(F.map_contains_key(short, w) & (x["tail"].startswith(".") | w.isin(*UNDOTTED)), F.element_at(short, w))
            .when(core.rlike(ORDINAL), F.concat(F.regexp_extract(core, ORDINAL, 1), F.when(ending.isin("°", "º"), "°").otherwise(F.lower(ending))))
            .when((core != F.upper(core)) & (core != w), core)
            .when(~x["first"] & ((w == "y") | (w.isin(*LETTERS) & ~x["coded"])), w)
            .when(core.rlike(DIRECTION) & ((n > 1) | x["first"] | x["coded"]), F.upper(core))
            .when(core.rlike(CODE) | (core.rlike("^\\p{L}{1,2}$") & ~w.isin(*SHORT_WORDS)), F.upper(core))
            .when(~core.contains("-") & ~x["first"] & w.isin(*PARTICLES), w))

    told = F.transform(low, lambda x: F.struct(x["raw"].alias("raw"), x["head"].alias("head"), x["core"].alias("core"), x["tail"].alias("tail"), x["first"].alias("first"), shown(x).alias("fixed")))
    # a word of signs alone stays; an abbreviation's own dot takes the place of the one that follows
    tail = lambda x: F.when(x["fixed"].endswith(".") & x["tail"].startswith("."), F.substr(x["tail"], F.lit(2))).otherwise(x["tail"])
    return F.transform(told, lambda x: F.struct(
        F.when(x["core"] == "", x["raw"]).otherwise(x["head"]).alias("head"), x["core"].alias("core"), F.when(x["core"] == "", "").otherwise(tail(x)).alias("tail"), x["first"].alias("first"), x["fixed"].alias("fixed")))


def pieces(text: Column) -> Column:
    """before, core, after and fixed of the words of a text in order, words with hyphens in parts."""
    raws = F.filter(F.split(text, " "), lambda w: w != "")
    words = judged(F.transform(raws, lambda w, i: F.struct(w.alias("raw"), (i == 0).alias("first"), F.when(i > 0, F.get(raws, i - 1)).otherwise("").alias("prev"))))
    single = lambda w, lead: F.struct(F.concat(lead, w["head"]).alias("before"), w["core"].alias("core"), w["tail"].alias("after"), w["fixed"].alias("fixed"))

    def parts(w: Column, lead: Column) -> Column:
        raw = F.split(w["core"], "-")
        got = judged(F.transform(raw, lambda p, j: F.struct(p.alias("raw"), (w["first"] & (j == 0)).alias("first"), F.lit("").alias("prev"))))
        before = lambda j: F.when(j == 0, F.concat(lead, w["head"])).otherwise("-")
        after = lambda j: F.when(j == F.size(raw) - 1, w["tail"]).otherwise("")
        return F.transform(got, lambda p, j: F.struct(F.concat(before(j), p["head"]).alias("before"), p["core"].alias("core"), F.concat(p["tail"], after(j)).alias("after"), p["fixed"].alias("fixed")))

    lead = lambda i: F.when(i == 0, "").otherwise(" ")
    return F.flatten(F.transform(words, lambda w, i: F.when(w["fixed"].isNull() & w["core"].contains("-"), parts(w, lead(i))).otherwise(F.array(single(w, lead(i))))))


def titles(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, label of each distinct name in Spanish title case; null and blank names have none.

    Abbreviations, ordinals, directions, codes and words of mixed case have their own forms. Other words take their known
    spelling; one that is not known and has "ni" before a vowel takes that of the word with ñ, if there is one.
    """
    n = mended(names.select("name").filter("name is not null").distinct(), known)
    p = n.select("name", F.posexplode(pieces(F.col("text"))).alias("i", "p")).select("name", "i", "p.*").withColumn("word", F.when(F.col("fixed").isNull(), F.lower("core")))
    w = F.col("word")
    at = F.filter(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(w, i, F.lit(3)).rlike("^ni[aeiou]"))
    tilde = F.transform(at, lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.lit("ñ"), F.substr(w, i + 2)))
    tries = F.transform(F.concat(F.array(w), tilde), lambda a: F.struct(a.alias("attempt"), a.alias("what")))
    spelled = first_known(p.filter(w.isNotNull() & ~w.isin(*UNACCENTED)).select("word").distinct().withColumn("tries", tries), "word", known).select("word", "spelling")
    p = p.join(spelled, "word", "left")
    word = F.coalesce("spelling", "word")
    shown = F.concat("before", F.coalesce("fixed", F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.substr(word, F.lit(2)))), "after")
    rows = p.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", shown.alias("s")))).alias("s"))
    return rows.select("name", F.array_join(F.transform("s", lambda x: x["s"]), "").alias("label"))


def street_labels(streets: DataFrame, known: DataFrame) -> DataFrame:
    """streets with label, out of name and kind: the kind's prefix unless the name says it, then what stands in parentheses."""
    both = "^(.*?)\\s*\\(\\s*(.+?)\\s*\\)?\\s*$"
    raw = F.trim(F.regexp_replace(F.regexp_replace("name", "\\.(?=\\S)", ". "), "\\s+", " "))
    before, within = F.regexp_extract("raw", both, 1), F.trim(F.regexp_extract("raw", both, 2))
    main = F.when(~F.col("raw").rlike(both), F.col("raw")).when(before != "", F.regexp_replace(before, "^[ -]+|[ -]+$", "")).otherwise(within)
    s = streets.withColumn("raw", raw).withColumns({"main": main, "extra": F.when(before != "", within)})
    t = titles(s.select(F.explode(F.array("main", "extra")).alias("name")), known)
    s = s.join(t.select(F.col("name").alias("main"), F.col("label").alias("l1")), "main", "left").join(t.select(F.col("name").alias("extra"), F.col("label").alias("l2")), "extra", "left")
    prefix = reduce(lambda c, p: c.when(F.col("kind") == p[0], p[1]), PREFIXES.items(), F.when(F.lit(False), ""))
    told = F.col("main").rlike(f"(?i)^(?:\\d+\\S*\\s+)?(?:{'|'.join(KIND_WORDS)})\\b\\.?")
    one = F.concat_ws(" ", F.when(~told, prefix), F.coalesce("l1", F.lit("")))
    s = s.withColumn("one", F.when(F.col("name") != "", one))
    label = F.when(F.col("l2").isNotNull() & (fold(F.col("l2")) != fold(F.col("one"))), F.concat("one", F.lit(" - "), "l2")).otherwise(F.col("one"))
    return s.withColumn("label", F.nullif(F.trim(label), F.lit(""))).select(*streets.columns, "label")
