"""Validators as temporary SQL functions, so that a query may say `is_siren(x)`."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (arguments, type, body)
FUNCTIONS = {
    "is_siren": ("v STRING", "BOOLEAN", "coalesce(v rlike '^[0-9]{9}$' AND luhn_check(v), false)"),
    "is_siret": ("v STRING", "BOOLEAN", "coalesce(v rlike '^[0-9]{14}$' AND luhn_check(v), false)"),
    "is_card": ("v STRING", "BOOLEAN", "coalesce(v rlike '^[0-9]{13,19}$' AND luhn_check(v), false)"),
    "iban_key_fr": ("bban STRING", "STRING", "lpad(CAST(98 - CAST(bban || '152700' AS DECIMAL(38, 0)) % 97 AS STRING), 2, '0')"),
    "is_iban_fr": ("v STRING", "BOOLEAN", "coalesce(CASE WHEN v rlike '^FR[0-9]{25}$' THEN CAST(substring(v, 5) || '1527' || substring(v, 3, 2) AS DECIMAL(38, 0)) % 97 = 1 END, false)"),
    "tva_key_fr": ("siren STRING", "STRING", "lpad(CAST((12 + 3 * (CAST(siren AS BIGINT) % 97)) % 97 AS STRING), 2, '0')"),
    "is_tva_fr": ("v STRING", "BOOLEAN", "coalesce(CASE WHEN v rlike '^FR[0-9]{11}$' THEN (12 + 3 * (CAST(substring(v, 5) AS BIGINT) % 97)) % 97 = CAST(substring(v, 3, 2) AS INT) END, false)"),
    "is_phone_fr": ("v STRING", "BOOLEAN", r"coalesce(v rlike '^(0[1-9][0-9]{8}|[+]33[1-9][0-9]{8})$', false)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in this session; their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
