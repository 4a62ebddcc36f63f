"""Rule tables as ordered conditions: the first rule that holds gives the class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clean, fold, metres_in

# fixed values: pattern of the folded upper-case name, class, subclass, rank; in this order
POI_RULES = [
    (r"\bAEROPUERTO\b", "airport", "airport", 4),
    (r"\bTERMINAL TERRESTRE\b|\bTERMINAL (INTER)?PROVINCIAL\b|\bTERMINAL DE (BUSES|OMNIBUS|TRANSPORTE)\b", "bus", "bus_station", 6),
    (r"\bTERMINAL\b.*\b(METROVIA|TROLE|ECOVIA|METROBUS)\b|\bESTACION\b.*\b(METROVIA|TROLE|ECOVIA|METRO)\b", "bus", "bus_stop", 14),
    (r"\bESTACION\b.*\b(TREN|FERROCARRIL|FERREA)\b", "rail", "station", 12),
    (r"\bCENTRO COMERCIAL\b|\bMALL\b|\bSHOPPING\b|\bRIOCENTRO\b|\bQUICENTRO\b|\bSAN MARINO\b|\bPASEO SHOPPING\b|\bPLAZA COMERCIAL\b", "shop", "mall", 8),
    (r"\bSUPERMAXI\b|\bMEGAMAXI\b|\bSUPERMERCADO\b|\bHIPERMARKET\b|\bMI COMISARIATO\b|\bGRAN AKI\b|\bAKI\b|\bALMACENES TIA\b|\bTIA\b|\bSANTA MARIA\b.*\bSUPER", "shop", "supermarket", 14),
    (r"\bMERCADO\b", "shop", "marketplace", 12),
    (r"\bHOSPITAL\b", "hospital", "hospital", 8),
    (r"\bCLINICA\b|\bSUBCENTRO\b|\bCENTRO DE SALUD\b|\bDISPENSARIO\b|\bPUESTO DE SALUD\b|\bCENTRO MEDICO\b", "hospital", "clinic", 16),
    (r"\bFARMACIA\b|\bBOTICA\b|\bFYBECA\b|\bSANASANA\b|\bPHARMACY\b", "pharmacy", "pharmacy", 20),
    (r"\bUNIVERSIDAD\b|\bESCUELA POLITECNICA\b|\bESPOL\b|\bESPE\b|\bINSTITUTO (TECNOLOGICO|SUPERIOR)\b", "college", "university", 10),
    (r"\bUNIDAD EDUCATIVA\b|\bESCUELA\b|\bCOLEGIO\b|\bJARDIN DE INFANTES\b|\bCENTRO EDUCATIVO\b|\bCENTRO INFANTIL\b|\bCIBV\b|\bCDI\b|\bGUARDERIA\b|\bLICEO\b|\bACADEMIA\b", "school", "school", 18),
    (r"\bESTADIO\b", "stadium", "stadium", 10),
    (r"\bCOLISEO\b|\bPOLIDEPORTIVO\b|\bCOMPLEJO DEPORTIVO\b|\bPISCINA\b|\bGIMNASIO\b", "sports", "sports_centre", 16),
    (r"\bCANCHA\b", "sports", "pitch", 22),
    (r"\bMUSEO\b", "museum", "museum", 12),
    (r"\bBIBLIOTECA\b", "library", "library", 16),
    (r"\bTEATRO\b|\bCASA DE LA CULTURA\b|\bCENTRO CULTURAL\b", "theatre", "theatre", 14),
    (r"\bCINE\b|\bCINEMA\b|\bSUPERCINES\b|\bMULTICINES\b|\bCINEMARK\b", "cinema", "cinema", 16),
    (r"\bHOTEL\b|\bHOSTAL\b|\bHOSTERIA\b|\bHOSPEDAJE\b|\bRESIDENCIAL\b|\bLODGE\b|\bMOTEL\b", "lodging", "hotel", 18),
    (r"\bRESTAURANTE?\b|\bCHIFA\b|\bMARISQUERIA\b|\bPICANTERIA\b|\bPARRILLADA\b|\bASADERO\b|\bPOLLO\b|\bPIZZERIA\b|\bCAFETERIA\b|\bCEVICHERIA\b|\bCOMEDOR\b|\bKFC\b|\bMC ?DONALDS\b|\bBURGER\b|\bCAFE\b", "restaurant", "restaurant", 20),
    (r"\bBANCO\b|\bCOOPERATIVA DE AHORRO\b|\bCAJERO\b|\bMUTUALISTA\b|\bBANECUADOR\b", "bank", "bank", 18),
    (r"\bUPC\b|\bUVC\b|\bPOLICIA\b|\bCOMANDO\b.*\bPOLICIA|\bUNIDAD DE VIGILANCIA\b|\bRETEN\b|\bDINAPEN\b|\bGEMA\b|\bUPC\d", "police", "police", 16),
    (r"\bBOMBEROS?\b", "fire_station", "fire_station", 16),
    (r"\bMUNICIPIO\b|\bALCALDIA\b|\bMUNICIPALIDAD\b|\bGAD\b|\bGOBIERNO AUTONOMO\b|\bGOBERNACION\b|\bPREFECTURA\b|\bCONSEJO PROVINCIAL\b|\bTENENCIA POLITICA\b|\bJUNTA PARROQUIAL\b|\bPALACIO MUNICIPAL\b", "town_hall", "town_hall", 12),
    (r"\bMINISTERIO\b|\bREGISTRO CIVIL\b|\bSRI\b|\bFISCALIA\b|\bJUDICATURA\b|\bUNIDAD JUDICIAL\b|\bCORTE\b|\bCNE\b|\bAGENCIA NACIONAL DE TRANSITO\b|\bANT\b|\bIESS\b|\bECU ?911\b|\bSECRETARIA\b|\bDEFENSORIA\b|\bCONTRALORIA\b|\bASAMBLEA\b|\bCARONDELET\b", "government", "government", 16),
    (r"\bCEMENTERIO\b|\bCAMPOSANTO\b|\bJARDINES DEL\b", "cemetery", "cemetery", 18),
    (r"\bGASOLINERA\b|\bESTACION DE SERVICIO\b|\bPETROECUADOR\b.*\bSERVICIO|\bPRIMAX\b|\bTERPEL\b|\bMOBIL\b", "fuel", "fuel", 18),
    (r"\bCORREOS?\b", "post", "post_office", 20),
    (r"\bFUERTE MILITAR\b|\bCUARTEL\b|\bBATALLON\b|\bBASE NAVAL\b|\bBASE AEREA\b|\bBRIGADA\b|\bDESTACAMENTO\b|\bCOMANDO CONJUNTO\b", "military", "military", 16),
    (r"\bMUELLE\b|\bEMBARCADERO\b|\bPUERTO\b(?!.*\bCAMARONERA)", "ferry", "ferry_terminal", 14),
    (r"\bIGLESIA\b|\bCAPILLA\b|\bTEMPLO\b|\bCATEDRAL\b|\bBASILICA\b|\bSANTUARIO\b|\bMEZQUITA\b|\bSINAGOGA\b|\bSALON DEL REINO\b|\bCONVENTO\b|\bMONASTERIO\b|\bPARROQUIA ECLESIASTICA\b|\bMISION\b", "place_of_worship", "place_of_worship", 18),
    (r"\bPARQUE\b|\bJARDIN BOTANICO\b|\bBOSQUE PROTECTOR\b", "park", "park", 14),
    (r"\bMALECON\b", "park", "promenade", 10),
    (r"\bPLAZA\b|\bPLAZOLETA\b", "park", "square", 16),
    (r"\bMONUMENTO\b|\bMIRADOR\b|\bFARO\b|\bHEMICICLO\b|\bTORRE\b", "attraction", "viewpoint", 14),
    (r"\bCASA COMUNAL\b|\bSALON COMUNAL\b|\bCENTRO COMUNITARIO\b|\bSEDE SOCIAL\b", "community", "community_centre", 22),
]
# fixed values: class by category where no name rule holds
POI_CATEGORIES = {
    "TEMPLO RELIGIOSO": ("place_of_worship", "place_of_worship", 20), "EDIFICIO EDUCACIONAL": ("school", "school", 20),
    "ESTABLECIMIENTO DE SALUD": ("hospital", "clinic", 18), "CAMPO DEPORTIVO": ("sports", "pitch", 22), "PARQUE": ("park", "park", 18),
    "CEMENTERIO": ("cemetery", "cemetery", 20), "GASOLINERA": ("fuel", "fuel", 18), "PLAZA": ("park", "square", 18),
    "CASA COMUNAL": ("community", "community_centre", 22), "EDIFICIO IMPORTANTE": ("building", "landmark", 18), "EDIFICIO DE REFERENCIA": ("building", "reference", 22),
}
# fixed values: class, first zoom and whether it is a ramp by highway tag
HIGHWAYS = {
    "motorway": ("motorway", 4, False), "motorway_link": ("motorway", 9, True), "trunk": ("trunk", 5, False), "trunk_link": ("trunk", 9, True),
    "primary": ("primary", 7, False), "primary_link": ("primary", 11, True), "secondary": ("secondary", 9, False), "secondary_link": ("secondary", 11, True),
    "tertiary": ("tertiary", 10, False), "tertiary_link": ("tertiary", 12, True), "unclassified": ("minor", 12, False), "residential": ("minor", 12, False),
    "living_street": ("minor", 12, False), "road": ("minor", 12, False), "busway": ("busway", 12, False), "bus_guideway": ("busway", 12, False),
    "service": ("service", 13, False), "track": ("track", 13, False), "pedestrian": ("path", 13, False), "footway": ("path", 14, False), "path": ("path", 14, False),
    "cycleway": ("path", 14, False), "bridleway": ("path", 14, False), "steps": ("path", 14, False), "corridor": ("path", 14, False),
}
# fixed values: surfaces
PAVED = ("paved", "asphalt", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "sett", "cobblestone", "metal", "wood", "unhewn_cobblestone", "bricks", "chipseal")
UNPAVED = ("unpaved", "compacted", "dirt", "earth", "fine_gravel", "grass", "grass_paver", "gravel", "ground", "mud", "pebblestone", "rock", "salt", "sand", "woodchips")
# fixed values: thermal bands by a part of the thermotype's name
THERMAL = (("crioro", 1), ("orotropical", 2), ("supratropical", 3), ("mesotropical", 4), ("termotropical", 5), ("infratropical", 6))


def first_rule(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), otherwise)


def poi(cls: str, subclass: str, rank: int) -> Column:
    return F.struct(F.lit(cls).alias("class"), F.lit(subclass).alias("subclass"), F.lit(rank).alias("rank"))


def poi_class(name: Column, category: Column) -> Column:
    """class, subclass and rank of a point of interest by its name, else by its category."""
    text = F.upper(fold(name))
    by_name = [((text != "") & text.rlike(p), poi(c, s, r)) for p, c, s, r in POI_RULES]
    by_category = [(F.coalesce(category == k, F.lit(False)), poi(*v)) for k, v in POI_CATEGORIES.items()]
    return first_rule(by_name + by_category, poi("building", "landmark", 24))


# fixed values: states in which an establishment is open, words of those that are no place, and words of names with class, subclass and rank; in this order
HEALTH_OPEN = ("ACTIVADO", "ACTIVO", "HABILITADO")
HEALTH_SKIP = "AMBULANCIA|UNIDAD MOVIL|VEHICULO|TRANSPORTE PRIMARIO|ATENCION DOMICILIARIA"
HEALTH_RULES = (
    (("hospital",), ("hospital", "hospital", 8)),
    (("centro de salud", "puesto de salud", "centro de especialidades"), ("hospital", "clinic", 14)),
    (("laboratorio", "radiologia", "diagnostico", "banco de sangre"), ("hospital", "health_lab", 24)),
    (("consultorio", "optometria", "podologia"), ("hospital", "doctor", 26)),
)
HEALTH_OTHER = ("hospital", "clinic", 20)


def health_class(typology: Column, state: Column) -> Column:
    """class, subclass and rank of a health establishment; null for vehicles, visits and those that are closed."""
    t = F.coalesce(clean(typology), F.lit(""))
    key = fold(t)
    open_ = F.upper(F.coalesce(clean(state), F.lit(HEALTH_OPEN[0]))).isin(*HEALTH_OPEN)
    skip = F.upper(key).rlike(HEALTH_SKIP)
    rules = [(reduce(Column.__or__, [key.contains(w) for w in words]), poi(*of)) for words, of in HEALTH_RULES]
    return F.when(open_ & ~skip, first_rule(rules, poi(*HEALTH_OTHER)))


def area_class(kind: Column, people: Column) -> Column:
    """class, rank and place rank of a built-up area by its kind and inhabitants."""
    big = F.when(people >= 200_000, 6).otherwise(0)
    of = lambda c, r, p: F.struct(F.lit(c).alias("class"), (F.lit(r) + big).alias("rank"), p.alias("place_rank"))
    rules = [
        (kind == "CAPITAL PROVINCIAL", of("city", 88, F.when(people > 1_000_000, 1).otherwise(2))),
        (kind == "CABECERA CANTONAL", of("town", 80, F.lit(3))),
        (kind == "CABECERA PARROQUIAL", of("village", 66, F.lit(4))),
    ]
    return first_rule([(F.coalesce(c, F.lit(False)), v) for c, v in rules], of("hamlet", 56, F.lit(5)))


def place_class(place: Column, people: Column) -> Column:
    """class, rank and first zoom of a place tag; null for others."""
    of = lambda c, r, z: F.struct(F.lit(c).alias("class"), F.lit(r).alias("rank"), (z if isinstance(z, Column) else F.lit(z)).alias("zoom"))
    rules = [
        (place == "country", of("country", 1, 2)), (place.isin("state", "province", "region"), of("state", 2, 4)),
        (place == "city", of("city", 3, F.when(people >= 1_000_000, 4).when(people >= 250_000, 5).otherwise(6))),
        (place == "town", of("town", 4, F.when(people >= 50_000, 7).otherwise(8))), (place == "village", of("village", 5, 11)), (place == "island", of("island", 5, 8)),
        (place.isin("suburb", "borough"), of("suburb", 6, 11)), (place == "quarter", of("quarter", 6, 13)), (place == "neighbourhood", of("neighbourhood", 7, 13)),
        (place == "hamlet", of("hamlet", 7, 13)), (place == "islet", of("islet", 7, 13)), (place.isin("locality", "isolated_dwelling", "square", "farm"), of("locality", 8, 14)),
    ]
    return first_rule([(F.coalesce(c, F.lit(False)), v) for c, v in rules], F.lit(None))


def highway_class(highway: Column) -> Column:
    """class, zoom and ramp of a highway tag; null for others."""
    rules = [(F.coalesce(F.lower(F.trim(highway)) == k, F.lit(False)), F.struct(F.lit(c).alias("class"), F.lit(z).alias("zoom"), F.lit(r).alias("ramp"))) for k, (c, z, r) in HIGHWAYS.items()]
    return first_rule(rules, F.lit(None))


def surface_class(surface: Column) -> Column:
    s = F.lower(F.trim(surface))
    return F.when(s.isin(*PAVED), "paved").when(s.isin(*UNPAVED), "unpaved")


def brunnel(bridge: Column, tunnel: Column, covered: Column, ford: Column) -> Column:
    set_ = lambda c: c.isNotNull() & (c != "no")
    return F.when(set_(bridge), "bridge").when(set_(tunnel) | F.coalesce(covered == "yes", F.lit(False)), "tunnel").when(set_(ford), "ford")


def thermal_band(thermotype: Column) -> Column:
    t = F.lower(thermotype)
    return first_rule([(t.contains(part), F.lit(band)) for part, band in THERMAL], F.lit(4))


def building_height(height: Column, levels: Column, low: Column, low_level: Column) -> Column:
    """height and min_height in metres, from levels of 3 m where no height is given; null where implausible."""
    h = F.coalesce(metres_in(height), metres_in(levels) * 3)
    m = F.coalesce(metres_in(low), metres_in(low_level) * 3)
    h = F.when((h > 0) & (h < 1000), h)
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    return F.struct(tenth(h).alias("height"), F.when((m > 0) & (m < h), tenth(m)).alias("min_height"))


def road_zoom(cls: Column, numbered: Column) -> Column:
    """First zoom of a road in the detailed network."""
    return F.when(cls.isin("motorway", "trunk", "primary"), F.when(numbered, 12).otherwise(10)).when(cls == "secondary", 11).when(cls.isin("tertiary", "street", "track"), 13).otherwise(14)


def road_name_zoom(cls: Column) -> Column:
    return F.when(cls.isin("motorway", "trunk", "primary"), 12).when(cls == "secondary", 13).otherwise(14)


def road_sort_key(cls: Column) -> Column:
    return first_rule([(cls == c, F.lit(k)) for c, k in (("motorway", 90), ("trunk", 80), ("primary", 70), ("secondary", 60), ("tertiary", 50), ("street", 40), ("service", 30), ("track", 30))], F.lit(20))


def poi_zoom(rank: Column) -> Column:
    return F.when(rank <= 8, 12).when(rank <= 14, 13).otherwise(14)


def street_rank(kind: Column, metres: Column) -> Column:
    """Rank of a street by kind, and a point per kilometre up to six."""
    base = F.when(kind.isin("AUTOPISTA", "PANAMERICANA", "CARRETERA", "CIRCUNVALACION", "VIA"), 58).when(kind == "AVENIDA", 54).when(kind.isNull() | kind.isin("CALLE", "TRANSVERSAL", "DIAGONAL"), 44).otherwise(34)
    return base + F.least(F.lit(6), F.floor(metres / 1000)).cast("int")
