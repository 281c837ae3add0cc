"""The concept dictionary, concept lists per encounter type, vital-sign patterns."""

# --- fixed values: code, label, manifest line, unit, FHIR type, category, value type

CONCEPTS = [
    ("5088", "temperature_c", "temperature_c (number, C)", "C", "Observation", "exam", "Quantity"),
    ("5085", "systolic_blood_pressure", "systolic_blood_pressure (number, mmHg)", "mmHg", "Observation", "exam", "Quantity"),
    ("5086", "diastolic_blood_pressure", "diastolic_blood_pressure (number, mmHg)", "mmHg", "Observation", "exam", "Quantity"),
    ("5087", "pulse", "pulse (number, beats/min)", "beats/min", "Observation", "exam", "Quantity"),
    ("5092", "arterial_blood_oxygen_saturation_pulse_oximeter", "arterial_blood_oxygen_saturation_pulse_oximeter (number)", "%", "Observation", "exam", "Quantity"),
    ("5089", "weight_kg", "weight_kg (number, kg)", "kg", "Observation", "exam", "Quantity"),
    ("5090", "height_cm", "height_cm (number, cm)", "cm", "Observation", "exam", "Quantity"),
    ("5242", "respiratory_rate", "respiratory_rate (number)", "breaths/min", "Observation", "exam", "Quantity"),
    ("1342", "body_mass_index", "body_mass_index (number, kg/m2)", "kg/m2", "Observation", "exam", "Quantity"),
    ("159368", "duration_of_illness", "duration_of_illness (number)", None, "Observation", "exam", "Quantity"),
    ("160347", "glasgow_coma_scale", "glasgow_coma_scale (number)", None, "Observation", "exam", "Quantity"),
    ("166589", "visual_analog_scale_pain_score", "visual_analog_scale_pain_score (number)", None, "Observation", "exam", "Quantity"),
    ("161422", "number_of_missed_medication_doses_yesterday", "number_of_missed_medication_doses_yesterday (number)", None, "Observation", "exam", "Quantity"),
    ("162660", "total_urine_output_over_24_hours_ml", "total_urine_output_over_24_hours_ml (number, mL)", "mL", "Observation", "exam", "Quantity"),
    ("730", "cd4_percent", "[test] cd4_percent (number)", "%", "Observation", "laboratory", "Quantity"),
    ("5497", "cd4_count", "[test] cd4_count (number)", "cells/uL", "Observation", "laboratory", "Quantity"),
    ("160912", "fasting_blood_glucose_measurement_mg_dl", "[test] fasting_blood_glucose_measurement_mg_dl", "mg/dL", "Observation", "laboratory", "Quantity"),
    ("169187", "finger_stick_blood_glucose", "[test] finger_stick_blood_glucose", "mg/dL", "Observation", "laboratory", "Quantity"),
    ("167176", "post_prandial_blood_glucose_measurement_mg_dl_1_5_hour_after_meal",
     "[test] post_prandial_blood_glucose_measurement_mg_dl_1_5_hour_after_meal", "mg/dL", "Observation", "laboratory", "Quantity"),
    ("887", "serum_glucose", "[test] serum_glucose", "mg/dL", "Observation", "laboratory", "Quantity"),
    ("5475", "tuberculin_skin_test_mm", "[test] tuberculin_skin_test_mm", "mm", "Observation", "laboratory", "Quantity"),
    ("5314", "head_circumference", "head_circumference (number, cm)", "cm", "Observation", "exam", "Quantity"),
    ("1343", "mid_upper_arm_circumference_cm", "mid_upper_arm_circumference_cm (number)", "cm", "Observation", "exam", "Quantity"),
    ("5916", "birth_weight_kg", "birth_weight_kg (number, kg)", "kg", "Observation", "exam", "Quantity"),
    ("166604", "weight_on_admission_kg", "weight_on_admission_kg (number, kg)", "kg", "Observation", "exam", "Quantity"),
    ("163166", "estimated_gestational_age_weeks", "estimated_gestational_age_weeks (number)", "weeks", "Observation", "exam", "Quantity"),
    ("1160", "fetal_heart_rate", "fetal_heart_rate (number)", "beats/min", "Observation", "exam", "Quantity"),
    ("1439", "fundal_height", "fundal_height (number, cm)", "cm", "Observation", "exam", "Quantity"),
    ("163460", "pre_gestational_weight_kg", "pre_gestational_weight_kg (number, kg)", "kg", "Observation", "exam", "Quantity"),
    ("165380", "weight_gain_since_last_visit_kg", "weight_gain_since_last_visit_kg (number, kg)", "kg", "Observation", "exam", "Quantity"),
]

# --- fixed values: concept codes per encounter type ----------------------------

ENCOUNTER_CONCEPTS = {
    "67a71486-1a54-468f-ac3e-7091a9a79584": [
        "5088", "5085", "5086", "5087", "5092", "5089", "5090", "5242", "1342", "5314",
    ],
    "d7151f82-c1f3-4152-a605-2f9ea7414a79": [
        "5088", "5085", "5086", "5087", "5092", "5089", "5090", "5242", "1342", "159368", "160347", "166589",
        "161422", "730", "5497", "160912", "169187", "167176", "887",
    ],
    "dd528487-82a5-4082-9c72-ed246bd49591": [
        "5088", "5085", "5086", "5087", "5092", "5089", "5090", "5242", "1342", "159368", "160347", "166589",
        "161422", "730", "5497", "160912", "169187", "167176", "887",
    ],
    "3596fafb-6f6f-4396-8c87-6e63a0f1bd71": [
        "730", "5497", "160912", "169187", "167176", "887", "162660", "5475",
    ],
    "0e8230ce-bd1d-43f5-a863-cf44344fa4b0": [
        "5088", "5085", "5086", "5087", "5092", "5089", "5090", "5242", "1342", "159368", "160347", "166589",
        "161422", "730", "5497", "160912",
    ],
    "e22e39fd-7db2-45e7-80f1-60fa0d5a4378": [
        "5088", "5085", "5086", "5087", "5092", "5089", "5090", "5242", "163166", "1160", "1439", "163460", "5916",
        "165380", "166604",
    ],
    "6d88e570-a489-4e31-9e0a-5406c2e75d9e": [
        "5088", "5085", "5086", "5087", "5092", "5089", "5090", "5242", "5314", "1343", "5916", "166604",
    ],
}
DEFAULT_CONCEPTS = [
    "5088", "5085", "5086", "5087", "5092", "5089", "5090", "5242", "1342", "159368", "160347", "166589", "161422",
    "730", "5497", "160912", "169187", "167176", "887", "163166", "1160", "1439", "163460", "5916", "165380",
    "166604", "5314", "1343", "162660",
]

# --- fixed values: vital signs in free text: pattern, code, label, units ---------

VITAL_SIGNS = [
    (r"(?:temperature|temp)\s+(\d+\.?\d*)", 5088, "Temperature (C)", "DEG C"),
    (r"(?:bp|blood\s*pressure)\s+(\d+)\s*(?:over|/)", 5085, "Systolic Blood Pressure", "mmHg"),
    (r"(?:bp|blood\s*pressure)\s+\d+\s*(?:over|/)\s*(\d+)", 5086, "Diastolic Blood Pressure", "mmHg"),
    (r"(?:heart\s*rate|pulse|hr)\s+(\d+)", 5087, "Heart Rate", "bpm"),
    (r"(?:oxygen\s*sat|spo2|sp\s*o\s*2|o2\s*sat|saturation|sats?)\s+(\d+)", 5092, "SpO2", "%"),
    (r"(?:weight|wt)\s+(\d+\.?\d*)", 5089, "Weight (kg)", "kg"),
    (r"(?:height|ht)\s+(\d+\.?\d*)", 5090, "Height (cm)", "cm"),
    (r"(?:respiratory\s*rate|resp\s*rate|rr|respirations)\s+(\d+)", 5242, "Respiratory Rate", "breaths/min"),
    (r"(?:blood\s*(?:sugar|glucose)|glucose|bsl|rbs)\s+(\d+\.?\d*)", 887, "Blood Glucose", "mg/dL"),
]

# --- fixed values: key/value lines that are prose, not observations ---------------

PROSE_PREFIXES = [
    "i need", "i will", "let me", "the patient", "observations", "concept",
    "extract", "here", "based on", "from the", "audio", "manifest", "note",
    "output", "result",
]
