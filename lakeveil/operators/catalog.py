"""Kinds of findings: label, placeholder token, whether they are looked for by default, whether they are drawn areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: key, label, token, on by default, area
ENTITIES = [
    ("PERSON", "Person", "NAME", True, False),
    ("LOCATION", "Place", "PLACE", True, False),
    ("ORGANIZATION", "Organisation", "ORG", False, False),
    ("DE_ADDRESS", "Address", "ADDRESS", True, False),
    ("EMAIL_ADDRESS", "E-mail", "EMAIL", True, False),
    ("PHONE_NUMBER", "Phone", "PHONE", True, False),
    ("DATE_TIME", "Date", "DATE", True, False),
    ("IBAN_CODE", "IBAN", "IBAN", True, False),
    ("CREDIT_CARD", "Card", "CARD", True, False),
    ("IP_ADDRESS", "IP address", "IP", True, False),
    ("URL", "Link", "URL", False, False),
    ("DE_TAX_ID", "Tax ID", "TAXID", True, False),
    ("DE_TAX_NUMBER", "Tax number", "TAXNO", True, False),
    ("DE_VAT_ID", "VAT ID", "VATID", False, False),
    ("DE_SOCIAL_SECURITY", "Pension number", "PENSION", True, False),
    ("DE_HEALTH_INSURANCE", "Health insurance number", "HEALTH", True, False),
    ("DE_ID_CARD", "Identity card", "IDCARD", True, False),
    ("DE_PASSPORT", "Passport", "PASSPORT", True, False),
    ("DE_FUEHRERSCHEIN", "Driving licence", "LICENCE", True, False),
    ("DE_KFZ", "Number plate", "PLATE", True, False),
    ("DE_PLZ", "Postcode", "POSTCODE", True, False),
    ("DE_HANDELSREGISTER", "Commercial register", "REGISTER", False, False),
    ("DE_LANR", "Physician number", "PHYSICIAN", True, False),
    ("DE_BSNR", "Practice number", "PRACTICE", False, False),
    ("CUSTOM", "Own term", "TERM", True, False),
    ("CONTEXT", "Context", "CONTEXT", False, False),
    ("SECRET", "Secret", "SECRET", True, False),
    ("AREA", "Area", "AREA", False, True),
    ("AREA_SIGNATURE", "Signature", "SIGNATURE", False, True),
    ("AREA_IMAGE", "Image", "IMAGE", False, True),
    ("AREA_HANDWRITING", "Handwriting", "HANDWRITING", False, True),
]
AREAS = [e[0] for e in ENTITIES if e[4]]
DEFAULTS = [e[0] for e in ENTITIES if e[3]]
TOKENS = {e[0]: e[2] for e in ENTITIES}
LABELS = {e[0]: e[1] for e in ENTITIES}


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITIES, "entity_type string, label string, token string, default_on boolean, area boolean")


def _lookup(names: dict[str, str], key, other):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), other)


def token(entity_type):
    """Placeholder token; an unknown kind is its own."""
    return _lookup(TOKENS, entity_type, entity_type)


def label(entity_type):
    return _lookup(LABELS, entity_type, F.initcap(F.replace(entity_type, F.lit("_"), F.lit(" "))))
