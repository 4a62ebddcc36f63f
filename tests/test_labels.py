import pytest

from meridia.operators import labels

TITLES = {
    "MALECON SIMON BOLIVAR": "Malecón Simón Bolívar", "9 DE OCTUBRE Y BOYACA": "9 de Octubre y Boyaca", "JUAN GOMEZ RENDON": "Juan Gómez Rendón",
    "LOTIZACION LAS PALMAS": "Lotización las Palmas", "DR. JUAN MONTALVAN CORNEJO": "Dr. Juan Montalván Cornejo", "A": "A", "C-10": "C-10", "Oe18B": "Oe18B",
    "EL ORO": "El Oro", "TERMINAL DE BANIOS": "Terminal de Baños", "NUESTRA SENIORA DE LA PAZ": "Nuestra Señora de la Paz", "COLONIA DANIEL": "Colonia Daniel",
    "2\ufffd PASAJE 24 S-O": "2° Pasaje 24 S-O", "SE\ufffdORA A\ufffdO (MALECON) X\ufffdT": "Señora Año (Malecón) XT", "SAN-GOMEZ DE-LA (\"": "San-Gómez DE-LA (\"",
    "1ER Y 2DA O E": "1er y 2da O E", "CASA O E": "Casa o E", "AV 3 Y CL. 4": "Av. 3 y C. 4", "BJ SU KM. 5": "BJ Su km. 5", "5º NORTE": "5° Norte",
}
STREETS = {
    ("AVENIDA", "12 S-E (MALECON SIMON BOLIVAR PALACIOS)"): "Av. 12 S-E - Malecón Simón Bolívar Palacios", ("CALLE", "MALECON DEL SALADO"): "Malecón del Salado",
    ("CALLE", "SENEGAL"): "C. Senegal", ("CALLEJON", "2DO CJON.5 N-O (MALECON DEL SALADO)"): "2do Cjón. 5 N-O - Malecón del Salado", ("PASAJE", "10MO PSJE. 25A N-O"): "10mo Pje. 25A N-O",
    ("CALLE", "49 S-O (DR. JUAN MONTALVAN CORNEJO)"): "C. 49 S-O - Dr. Juan Montalván Cornejo", ("AVENIDA", "EJE S-O (BLVD. 9 DE OCTUBRE)"): "Eje S-O - Blvd. 9 de Octubre",
    ("CALLE", "4"): "C. 4", (None, "ORO (oro)"): "Oro", ("OTHER", "ORO"): "Oro", ("CALLE", "(ORO"): "C. Oro", ("CALLE", None): None, ("CALLE", ""): None,
}


@pytest.fixture(scope="module")
def known(spark):
    cur = spark.createDataFrame([(w,) for w in "Malecón Simón Bolívar Gómez Rendón Montalván Baños Señora Unión".split()], "spelling string")
    seen = spark.createDataFrame([("LOTIZACIÓN HUERTOS",), ("LOTIZACIÓN LAS",), ("Boyacá",), ("Óscar Óscar",), ("Gomèz Gomèz Gomèz",)], "name string")
    return labels.known_spellings(seen, cur)


def test_spellings_that_are_known(known):
    got = {r.word: r.spelling for r in known.collect()}
    assert got["lotizacion"] == "lotización" and got["gomez"] == "gómez"  # seen twice; curated ones come first
    assert "boyaca" not in got and "oscar" not in got  # seen once; never accented


def test_titles(spark, known):
    names = [*TITLES, *TITLES, "", " ", None]
    got = {r.name: r.label for r in labels.titles(spark.createDataFrame([(n,) for n in names], "name string"), known).collect()}
    assert {n: x for n, x in got.items() if x} == TITLES


def test_street_labels(spark, known):
    rows = [(i, *k) for i, k in enumerate(STREETS)]
    df = spark.createDataFrame(rows + rows, "label_of int, kind string, name string")
    got = labels.street_labels(df, known).collect()
    assert len(got) == 2 * len(STREETS)
    assert {(r.kind, r.name): r.label for r in got} == STREETS


def test_empty_tables(spark, known):
    none = known.limit(0)
    assert labels.street_labels(spark.createDataFrame([], "kind string, name string"), none).count() == 0
    assert labels.titles(spark.createDataFrame([("BANIOS",)], "name string"), none).collect()[0].label == "Banios"
