"""DataFrame -> DataFrame operators of governed analytics."""

from custodia.operators.clinical import (
    age_band_average, age_band_values, birth_years, component_average, component_series,
    nutritional_data, patient_details, patient_documents,
)
from custodia.operators.cohort import (
    cohort_and_hot_keys, in_cohort, not_in_cohort, stroke_cohort, tests_with_profiles,
)
from custodia.operators.export import PUBLIC_COLUMNS, public_export, quasi_identifier_groups
from custodia.operators.privacy import (
    generalise_birth_date, mask_by_clauses, pseudonymise_id, suppress_id,
)
from custodia.operators.rows import (
    drop_denied_rows, json_component, parse_variant_rows, to_json_rows, to_variant_rows, variant_component,
)
from custodia.operators.skew import DEFAULT_SKEW, SkewPolicy, find_hot_keys, key_counts, salted_join

__all__ = [
    "age_band_average", "age_band_values", "birth_years", "component_average",
    "component_series", "nutritional_data", "patient_details", "patient_documents",
    "cohort_and_hot_keys", "in_cohort", "not_in_cohort", "stroke_cohort", "tests_with_profiles",
    "PUBLIC_COLUMNS", "public_export", "quasi_identifier_groups",
    "generalise_birth_date", "mask_by_clauses", "pseudonymise_id", "suppress_id",
    "drop_denied_rows", "json_component", "parse_variant_rows", "to_json_rows", "to_variant_rows",
    "variant_component",
    "DEFAULT_SKEW", "SkewPolicy", "find_hot_keys", "key_counts", "salted_join",
]
