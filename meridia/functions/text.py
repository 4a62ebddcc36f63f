"""Text keys as column expressions: folding, cleaning, variants, parsers."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that help ranking but never filter
SOFT_WORDS = (
    "de", "del", "la", "las", "los", "el", "en", "y", "e", "a", "al", "con",
    "calle", "c", "cl", "avenida", "av", "avda", "pasaje", "pje", "psje", "callejon", "cjon",
    "peatonal", "paseo", "via", "carretera", "autopista", "diagonal", "transversal", "redondel",
    "sector", "barrio", "parque", "cerca",
)
# fixed values: misspelt street kinds
KIND_TYPOS = {"PAETONAL": "PEATONAL", "ESCALINTA": "ESCALINATA", "CIRCUNVALCION": "CIRCUNVALACION"}


@cache
def _bases(form: str) -> tuple[str, str]:
    """Characters that decompose to one character and marks, and that character: a rule, not a list."""
    pairs = []
    for code in range(0x80, 0x10000):
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            base = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c:
                pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_marks(text: Column, form: str = "NFD") -> Column:
    """Letters without accents; signs that decompose into several letters stay."""
    return F.regexp_replace(F.translate(text, *_bases(form)), "\\p{M}+", "")


def fold(text: Column) -> Column:
    """Search key: lower case without accents, ASCII letters and digits separated by one blank; empty for null."""
    return F.trim(F.regexp_replace(without_marks(F.lower(F.coalesce(text, F.lit("")))), "[^0-9a-z]+", " "))


def fold_world(text: Column) -> Column:
    """As fold, but letters and digits of any script stay."""
    return F.trim(F.regexp_replace(F.lower(without_marks(F.coalesce(text, F.lit("")))), "[^\\p{L}\\p{N}]+", " "))


def tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda w: w != "")


def meaningful(words: Column) -> Column:
    """Words without the soft ones; all of them where only soft ones stand."""
    hard = F.filter(words, lambda w: ~w.isin(*SOFT_WORDS))
    return F.when(F.size(hard) > 0, hard).otherwise(words)


def variants(word: Column) -> Column:
    """The word and what it may be in the singular."""
    n = F.length(word)
    return F.filter(
        F.array(word, F.when((n > 4) & word.endswith("es"), F.substring(word, 1, n - 2)), F.when((n > 3) & word.endswith("s"), F.substring(word, 1, n - 1))),
        lambda w: w.isNotNull())


# fixed value: texts that stand for none
PLACEHOLDER = "(?i)^(?:S/?N\\.?|S\\.N\\.?|N/?N|SIN NOMBRE|NINGUNO|0+|-+|\\.+|\\?+)$"


def clean(text: Column) -> Column:
    """Trimmed text with single blanks; null for empty text and placeholders."""
    t = F.regexp_replace(F.translate(text, " ´`", " ''"), "\\s+", " ")
    t = F.regexp_replace(t, "^[ .,;:\\-\\t]+|[ .,;:\\-\\t]+$", "")
    return F.when((t != "") & ~t.rlike(PLACEHOLDER), t)


def street_kind(kind: Column) -> Column:
    """Kind in upper case without accents, with known misspellings mended."""
    k = F.upper(fold(clean(kind)))
    return F.when(clean(kind).isNotNull(), reduce(lambda c, p: F.when(k == p[0], p[1]).otherwise(c), KIND_TYPOS.items(), k))


def bracketed(name: Column) -> Column:
    """Texts in parentheses; a last one may lack its end."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("\\(([^)]+)\\)?"), 1), lambda a: F.trim(a)), lambda a: a != "")


def like_escaped(text: str) -> str:
    """A literal as the inside of a LIKE pattern with a backslash as escape."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)


def first_met(parts: Column) -> Column:
    """Parts whose folded text was not met before, nulls and blanks dropped."""
    given = F.filter(parts, lambda p: fold(p) != "")
    return F.filter(given, lambda p, i: F.array_position(F.transform(given, fold), fold(p)) == i + 1)


def versions_compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two versions whose parts stand between dots, hyphens or underscores.

    Parts missing on one side count as 0; two numbers compare as numbers, other parts as text.
    """
    x, y = F.split(F.trim(a), "[.\\-_]"), F.split(F.trim(b), "[.\\-_]")
    n = F.greatest(F.size(x), F.size(y))

    def part(i: Column) -> Column:
        p, q = F.coalesce(F.get(x, i), F.lit("0")), F.coalesce(F.get(y, i), F.lit("0"))
        u, v = F.when(p == "", F.lit(0.0)).otherwise(p.try_cast("double")), F.when(q == "", F.lit(0.0)).otherwise(q.try_cast("double"))
        return F.when(u.isNotNull() & v.isNotNull(), F.signum(u - v)).otherwise(F.when(p > q, 1.0).when(p < q, -1.0).otherwise(0.0)).cast("int")

    return F.coalesce(F.get(F.filter(F.transform(F.sequence(F.lit(0), n - 1), part), lambda s: s != 0), F.lit(0)), F.lit(0))


def numbers_in(text: Column) -> Column:
    """Numbers of a text, with a dot or comma before decimals."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(\\d+(?:[.,]\\d+)?)"), 1), lambda s: F.translate(s, ",", ".").cast("double"))


def metres_in(text: Column) -> Column:
    """A length such as 12, 12.5 or 12 m, or feet with a prime; null where it is none or negative."""
    t = F.trim(text)
    m = F.regexp_extract(t, "^(\\d+(?:\\.\\d+)?)\\s*(?:m|)$", 1)
    f = F.regexp_extract(t, "^(\\d+(?:\\.\\d+)?)'$", 1)
    return F.when(m != "", m.try_cast("double")).when(f != "", f.try_cast("double") * 0.3048)


def point_in(text: Column) -> Column:
    """lat and lon of a pair of numbers in a text, with dots or commas before decimals; null where there is none or out of range."""
    num = "([-+]?\\d{1,3}(?:%s\\d+)?)"
    dots = "^\\s*" + num % "\\." + "\\s*[,; ]\\s*" + num % "\\." + "\\s*$"
    commas = "^\\s*" + num % "," + "\\s*[; ]\\s*" + num % "," + "\\s*$"
    got = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, dots, i), F.lit("")), F.translate(F.nullif(F.regexp_extract(text, commas, i), F.lit("")), ",", "."))
    lat, lon = got(1).try_cast("double"), got(2).try_cast("double")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))
