"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from custodia.functions.columns import (
    COMPONENTS, MEASUREMENT_COLUMNS, PROFILE_COLUMNS, component_column,
)
from custodia.functions.predicates import any_present, birth_year_filter, years_before
from custodia.functions.pseudonyms import pseudonym, pseudonym_of

__all__ = [
    "COMPONENTS", "MEASUREMENT_COLUMNS", "PROFILE_COLUMNS", "component_column",
    "any_present", "birth_year_filter", "years_before", "pseudonym", "pseudonym_of",
]
