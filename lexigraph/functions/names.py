"""Namespaces, terms and labels of the vocabulary profile."""

DEFAULT_NS = "https://slovník.gov.cz/"
OFN = "https://slovník.gov.cz/generický/datový-slovník-ofn-slovníků/pojem/"
TIME_NS = "https://slovník.gov.cz/generický/čas/pojem/"
SHACL_LOCAL = "https://slovník.gov.cz/shacl/lokální/"
SHACL_GLOBAL = "https://slovník.gov.cz/shacl/globální/"
DIGITAL_OBJECT = "https://slovník.gov.cz/generický/digitální-objekty/pojem/digitální-objekt"
AGENDA_104 = DEFAULT_NS + "agendový/104/pojem/"
LAW_111 = DEFAULT_NS + "legislativní/sbírka/111/2009/pojem/"
LAW_360 = DEFAULT_NS + "legislativní/sbírka/360/2023/pojem/"
ELI_BASE = "https://opendata.eselpoint.cz/esel-esb/"
RPP = "https://rpp-opendata.egon.gov.cz/odrpp/zdroj/"

RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
SKOS, DCT, DC, SCHEMA_URL = "http://www.w3.org/2004/02/skos/core#", "http://purl.org/dc/terms/", "http://purl.org/dc/elements/1.1/", "http://schema.org/url"
TYPE = RDF + "type"

CONCEPT, CLASS, RELATION, PROPERTY = "pojem", "třída", "vztah", "vlastnost"
SUBJECT_TYPE, OBJECT_TYPE = "typ-subjektu-práva", "typ-objektu-práva"
PUBLIC, NON_PUBLIC = "veřejný-údaj", "neveřejný-údaj"
PPDF, AGENDA, AIS = "je-sdílen-v-ppdf", "agenda", "agendový-informační-systém"
PROVISION = "ustanovení-dokládající-neveřejnost-údaje"
PROVISION_FRAGMENT = "ustanovení-dokládající-neveřejnost"
DEFINING_LAW, DEFINING_OTHER = "definující-ustanovení-právního-předpisu", "definující-nelegislativní-zdroj"
RELATED_LAW, RELATED_OTHER = "související-ustanovení-právního-předpisu", "související-nelegislativní-zdroj"
PPDF_LONG, AGENDA_LONG, AIS_LONG = "je-sdílen-v-propojeném-datovém-fondu", "sdružuje-údaje-vedené-nebo-vytvářené-v-rámci-agendy", "údaje-jsou-v-ais"
PROVISION_LONG = "je-vymezen-ustanovení-stanovujícím-jeho-neveřejnost"

#: Predicates as built -> as published.
PUBLISHED = {
    DEFAULT_NS + PPDF: AGENDA_104 + PPDF_LONG,
    DEFAULT_NS + PROVISION: LAW_111 + PROVISION_LONG,
    DEFAULT_NS + AIS: AGENDA_104 + AIS_LONG,
    DEFAULT_NS + AGENDA: AGENDA_104 + AGENDA_LONG,
    DEFAULT_NS + DEFINING_LAW: OFN + DEFINING_LAW,
    DEFAULT_NS + RELATED_LAW: OFN + RELATED_LAW,
}
#: Czech labels of data types -> ranges.
DATA_TYPES = {
    "Ano či ne": XSD + "boolean",
    "Datum": XSD + "date",
    "Čas": XSD + "time",
    "Datum a čas": XSD + "dateTimeStamp",
    "Celé číslo": XSD + "integer",
    "Desetinné číslo": XSD + "double",
    "URI, IRI, URL": XSD + "anyURI",
    "Řetězec": XSD + "string",
    "Text": RDFS + "Literal",
}
#: Types of concepts -> labels in documents, in their order there.
TYPE_LABELS = {
    CONCEPT: "Pojem",
    CLASS: "Třída",
    RELATION: "Vztah",
    PROPERTY: "Vlastnost",
    SUBJECT_TYPE: "Typ subjektu práva",
    OBJECT_TYPE: "Typ objektu práva",
    PUBLIC: "Veřejný údaj",
    NON_PUBLIC: "Neveřejný údaj",
}
SEVERITY_LABELS = {"ERROR": ("Chyba", "Vysoká", "Violation"), "WARNING": ("Varování", "Střední", "Warning"), "INFO": ("Informace", "Nízká", "Info")}
#: Values that the governance fields may have, in lower case.
GOVERNANCE_VALUES = [
    "veřejně přístupné", "poskytované na žádost", "nesdílené", "zpřístupňované pro výkon agendy", "základních registrů", "jiných agend", "vlastní", "provozní", "identifikační",
    "evidenční", "statistické",
]
#: Predicates of the governance fields and their code lists.
GOVERNANCE = {
    "sharingMethod": (LAW_360 + "má-způsob-sdílení-údaje", "https://data.dia.gov.cz/zdroj/číselníky/způsoby-sdílení-údajů/položky/"),
    "acquisitionMethod": (LAW_360 + "má-způsob-získání-údaje", "https://data.dia.gov.cz/zdroj/číselníky/způsoby-získání-údajů/položky/"),
    "contentType": (LAW_360 + "má-typ-obsahu-údaje", "https://data.dia.gov.cz/zdroj/číselníky/typy-obsahu-údajů/položky/"),
}
