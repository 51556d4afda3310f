"""Names of the clinical columns.

Fixed values: these names must equal the ones the reference's queries and
stored tables use, so they are written out here as they are.
"""

from __future__ import annotations

# The ten blood-test components (spelling as stored, including
# "tryglicerides"), in alphabetical order.
COMPONENTS = (
    "antithrombin",
    "cholesterol_hdl",
    "cholesterol_ldl",
    "cholesterol_total",
    "cholesterol_tryglicerides",
    "fibrinogen",
    "haemoglobin",
    "plateletCount",
    "prothrombinTime",
    "totalWhiteCellCount",
)

# The one component that has no normal-range column, and the
# short name that maps to the total-cholesterol column.
NO_NORMAL_RANGE = ("plateletCount",)
COMPONENT_ALIASES = {"cholesterol": "cholesterol_total"}

# The fifteen patient-profile columns of the details query.
PROFILE_COLUMNS = (
    "addressCity", "addressRoad", "addressRoadNumber", "addressPostalCode",
    "addressTelephoneNumber", "birthCity", "nationality", "job", "schoolYears",
    "birthDate", "gender", "name", "patientId", "socialId", "surname",
)

# The nutritional-data projection.
NUTRITIONAL_COLUMNS = (
    "cholesterol_total_value", "cholesterol_ldl_value", "patientId", "bmi",
    "category", "birthDate", "gender",
)


# The 32 measurement columns carried into the public zone.
MEASUREMENT_COLUMNS = (
    "category", "prothrombinTime_unit", "cholesterol_hdl_value", "totalWhiteCellCount_unit",
    "fibrinogen_normalRange", "antithrombin_value", "fibrinogen_unit", "haemoglobin_value",
    "antithrombin_unit", "cholesterol_hdl_unit", "cholesterol_hdl_normalRange",
    "cholesterol_ldl_normalRange", "bmi", "antithrombin_normalRange",
    "totalWhiteCellCount_normalRange", "fibrinogen_value", "cholesterol_ldl_value",
    "plateletCount_value", "cholesterol_total_normalRange",
    "cholesterol_tryglicerides_normalRange", "totalWhiteCellCount_value", "date",
    "cholesterol_ldl_unit", "haemoglobin_unit", "prothrombinTime_value",
    "cholesterol_tryglicerides_unit", "plateletCount_unit", "cholesterol_total_value",
    "haemoglobin_normalRange", "prothrombinTime_normalRange",
    "cholesterol_tryglicerides_value", "cholesterol_total_unit",
)


def component_column(component: str) -> str:
    """Value column of a component, from an allow-list (no string splicing
    of caller text into SQL)."""
    name = COMPONENT_ALIASES.get(component, component)
    if name not in COMPONENTS:
        raise ValueError(f"unknown blood-test component: {component!r}")
    return f"{name}_value"
