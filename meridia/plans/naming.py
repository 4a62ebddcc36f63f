"""Queries over official names: street labels out of names in capitals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels
from ..sources.tables import load

# a form for each part in turn: kind, official name, display name; A and B stand for the words of the part's name
FORMS = (
    ("AVENIDA", "12 S-E (MALECON {A} {B})", "Av. 12 S-E - Malecón {A} {B}"), ("CALLE", "{A} Y {B}", "C. {A} y {B}"),
    ("CALLEJON", "2DO CJON.5 N-O ({A})", "2do Cjón. 5 N-O - {A}"), ("PASAJE", "10MO PSJE. {A} DE LA {B}", "10mo Pje. {A} de la {B}"),
    ("CALLE", "TERMINAL DE BANIOS {A}", "C. Terminal de Baños {A}"), ("AVENIDA", "(NUESTRA SENIORA DE LAS {B}", "Av. Nuestra Señora de las {B}"),
    ("VIA", "SE�ORA {A}, 2�", "Vía Señora {A}, 2°"), (None, "EJE S-O (BLVD. 9 DE {B})", "Eje S-O - Blvd. 9 de {B}"),
    ("CALLE", "{A}-{B}  C-10", "C. {A}-{B} C-10"), ("TUNEL", "Oe7B {A} E", "Túnel Oe7B {A} e"), (None, "{A} ({A})", "{A}"), ("CALLE", None, None),
)
CURATED = ("Malecón", "Baños", "Señora")


def filled(template: str | None, a, b):
    return F.lit(None).cast("string") if template is None else F.replace(F.replace(F.lit(template), F.lit("{A}"), a), F.lit("{B}"), b)


def official(s, d):
    """Streets named in capitals without accents, a form for each part in turn."""
    a, b = (F.upper(F.get(F.split("p_name", " "), F.lit(i))) for i in (0, 1))
    k = F.col("p_partkey") % len(FORMS)
    pick = lambda i: F.coalesce(*[F.when(k == n, filled(f[i], a, b)) for n, f in enumerate(FORMS)])
    return load(s, d, "part").select(F.col("p_partkey").alias("street"), pick(0).alias("kind"), pick(1).alias("name"))


def accented(s, d):
    """Names with accents, as another source shows them."""
    return load(s, d, "part").select(F.translate("p_name", "ao", "áó").alias("name"))


def street_labels(s, d):
    curated = s.createDataFrame([(w,) for w in CURATED], "spelling string")
    known = labels.known_spellings(accented(s, d), curated)
    return labels.street_labels(official(s, d), known).select("street", F.coalesce("label", F.lit("")).alias("label"))


def queries():
    return {"street_labels": street_labels}


def oracle_sql():
    shown = " ".join(f"when {n} then '{f[2]}'" for n, f in enumerate(FORMS) if f[2])
    return {"street_labels": f"""with w as (select p_partkey as street, translate(string_split(p_name, ' ')[1], 'ao', 'áó') as a, translate(string_split(p_name, ' ')[2], 'ao', 'áó') as b from part),
      n as (select w, count(*) as n from (select a as w from w union all select b from w) group by w), s as (select street, if(x.n >= 2, a, strip_accents(a)) as a, if(y.n >= 2, b, strip_accents(b)) as b from w join n x on x.w = a join n y on y.w = b)
      select street, coalesce(replace(replace(case street % {len(FORMS)} {shown} end, '{{A}}', upper(a[1]) || a[2:]), '{{B}}', upper(b[1]) || b[2:]), '') as label from s"""}
