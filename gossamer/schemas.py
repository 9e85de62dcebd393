"""Types, priorities and table schemas."""

from __future__ import annotations

TYPES = (
    "NIR", "SIREN", "SIRET", "IBAN", "TVA", "CARTE_BANCAIRE", "TELEPHONE", "PLAQUE_SIV", "REFERENCE_DOSSIER", "EMAIL", "DATE", "PATRONYME", "PRENOM", "COMMUNE",
    "VOIE", "CODE_POSTAL",
)

#: A type's priority among spans of equal confidence and length; absent: 0.
PRIORITY = {
    "SIRET": 6, "NIR": 5, "IBAN": 5, "TVA": 5, "CARTE_BANCAIRE": 4, "VOIE": 4, "SIREN": 3, "COMMUNE": 3, "TELEPHONE": 2, "PATRONYME": 2,
    "PRENOM": 1, "PLAQUE_SIV": 1, "REFERENCE_DOSSIER": 1, "EMAIL": 1, "DATE": 1,
}

#: French labels of the activity report; a type without one is shown as itself.
LABELS = {
    "NIR": "Numéro de sécurité sociale", "SIREN": "SIREN", "SIRET": "SIRET", "IBAN": "IBAN", "TVA": "TVA intracommunautaire", "CARTE_BANCAIRE": "Carte bancaire",
    "TELEPHONE": "Téléphone", "PLAQUE_SIV": "Plaque d'immatriculation", "REFERENCE_DOSSIER": "Référence de dossier", "EMAIL": "E-mail", "DATE": "Date",
    "PATRONYME": "Patronyme", "PRENOM": "Prénom", "COMMUNE": "Commune", "VOIE": "Voie",
}

SPAN_DDL = "struct<start: int, end: int, type: string, value: string, rule_id: string, confidence: double>"

REGISTRY_DDL = "scope string, entity_type string, clear_hmac string, surrogate string, format_pattern string, mode string, gazetteer_version string, schema_version int"
SCHEMA_VERSION = 1
GAZETTEER_DDL = "kind string, name string, key string, genre string, departement string, cnt long"


def entity_type(name: str) -> str:
    """The type of this name, in any case; ValueError if there is none."""
    found = str(name).upper()
    if found not in TYPES:
        raise ValueError(f"unknown entity type {name!r}")
    return found
