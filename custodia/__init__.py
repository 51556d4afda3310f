"""custodia: governed analytics on PySpark.

Policy-aware reads, cell masking, pseudonymisation, cohort queries,
anonymised export and staged data movement, all expressed as DataFrame
plans so Catalyst and AQE choose the physical strategy.
"""

from custodia.model import GovernedPlan, PolicyRequest, TableSpec, Zone
from custodia.operators import (
    age_band_average, age_band_values, component_series, drop_denied_rows, in_cohort,
    mask_by_clauses, not_in_cohort, nutritional_data, patient_details, patient_documents,
    public_export, pseudonymise_id, generalise_birth_date, salted_join, stroke_cohort,
    tests_with_profiles, to_json_rows,
)
from custodia.plans import (
    finish_movement, governed_query, run_governed, stage_governed, start_movement,
)
from custodia.sources import Catalog
from custodia.streaming import stream_movement

__all__ = [
    "GovernedPlan", "PolicyRequest", "TableSpec", "Zone", "Catalog",
    "age_band_average", "age_band_values", "component_series", "drop_denied_rows",
    "in_cohort", "mask_by_clauses", "not_in_cohort", "nutritional_data", "patient_details",
    "patient_documents", "public_export", "pseudonymise_id", "generalise_birth_date",
    "salted_join", "stroke_cohort", "tests_with_profiles", "to_json_rows",
    "finish_movement", "governed_query", "run_governed", "stage_governed", "start_movement",
    "stream_movement",
]
