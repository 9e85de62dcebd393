"""Plans: pruned scans, no cross products, no Python where expressions suffice."""

import pytest

from gossamer.plans import catalogue as C

SF = "/root/testdata/sf0.001"
#: Permutations of names, dates and plates need numbers beyond 64 bits or walks of unknown length: one Arrow function.
ARROW = {
    "permutation_bijection", "derangement_no_fixed_point", "plate_cipher_roundtrip", "date_cipher_roundtrip", "email_cipher_roundtrip", "reference_cipher_roundtrip",
    "mask_unmask_roundtrip", "no_clear_leak", "registry_injective", "unmask_ignores_unissued", "unmask_reformatted", "mask_documents", "mask_names_roundtrip", "mask_odd_blanks_roundtrip",
    "mask_all_types_no_leak", "residue_counts", "unknown_names_stay", "email_case_roundtrip", "determinism_repeats", "surnames_no_collision", "nir_corsica", "json_text_roundtrip", "coherent_postcodes",
    "mask_rows_as_engine",
}
#: Queries that write first and read again: their plan is that of the last read. And those with the plan of another.
WRITING = {"gazetteer_files", "gazetteer_first_wins", "text_files", "audit_sink", "registry_replay", "unmask_chunks"}
ALIKE = {
    "mask_odd_blanks_roundtrip", "mask_all_types_no_leak", "unknown_names_stay", "determinism_repeats", "email_case_roundtrip", "unmask_reformatted", "unmask_ignores_unissued", "no_clear_leak", "registry_injective", "mask_rows_as_engine",
    "json_text_roundtrip", "nir_corsica", "coherent_postcodes", "mask_documents",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(C.QUERIES) - WRITING - ALIKE))
def test_plan(spark, name):
    p = plan(C.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    if name not in ARROW:
        assert "Python" not in p and "Arrow" not in p and "Pandas" not in p


def test_pruned_scan(spark):
    p = plan(C.flagship(spark, SF))
    assert "ReadSchema: struct<text:string,lang:string,source:string>" in p
    assert p.count("Exchange hashpartitioning") == 1


def test_pushed_filter(spark):
    from gossamer.operators import detect as T

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = plan(docs.withColumn("s", T.emails(docs["text"])).where("lang = 'fr'").select("doc_id", "s"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in p
