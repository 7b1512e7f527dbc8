"""Schemas of the record sets, of triples and of validation results; every column is a nullable string."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


VOCABULARY = strings("name", "description", "namespace", "dateOfCreation", "dateOfModification")
CLASSES = strings(
    "id", "name", "type", "description", "definition", "source", "identifier", "relatedSource", "superClass", "alternativeName", "equivalentConcept", "sharedInPPDF", "agendaCode",
    "agendaSystemCode", "isPublic", "privacyProvision", "sharingMethod", "acquisitionMethod", "contentType",
)
PROPERTIES = strings(
    "id", "name", "domain", "description", "definition", "source", "identifier", "relatedSource", "superProperty", "alternativeName", "equivalentConcept", "dataType", "sharedInPPDF",
    "agendaCode", "agendaSystemCode", "isPublic", "privacyProvision", "sharingMethod", "acquisitionMethod", "contentType",
)
RELATIONSHIPS = strings(
    "domain", "name", "range", "relationshipType", "description", "definition", "source", "relatedSource", "sharedInPPDF", "agendaCode", "agendaSystemCode", "isPublic", "privacyProvision",
    "sharingMethod", "acquisitionMethod", "contentType", "superRelation", "alternativeName", "equivalentConcept", "identifier",
)
HIERARCHIES = strings("subClass", "superClass", "relationshipId", "relationshipName", "description", "definition", "source")
TRIPLES = strings("graph_id", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
RESULTS = strings("severity", "message", "ruleName", "focusNodeUri", "resultPathUri", "value")
