"""Item dictionaries and column orders of the clinical feature tables."""

from __future__ import annotations

from anchorkit.operators.windows import Item

# Vital signs (item id, feature, plausible range, conversion).
VITALS = [
    Item(220045, "heart_rate", 20, 300),
    Item(220277, "spo2", 70, 100),
    Item(220210, "resp_rate", 4, 60),
    Item(223761, "temperature", 85, 108, "f_to_c"),
    Item(223762, "temperature", 28, 42),
    Item(220739, "gcs_eye", 1, 4),
    Item(223900, "gcs_verbal", 1, 5),
    Item(223901, "gcs_motor", 1, 6),
]

# Laboratory tests (item id, feature, plausible range).
LABS = [
    Item(50868, "anion_gap", 1, 40),
    Item(50882, "bicarbonate", 5, 50),
    Item(50902, "chloride", 70, 140),
    Item(50912, "creatinine", 0.1, 20),
    Item(50931, "glucose", 33, 1000),
    Item(50983, "sodium", 100, 180),
    Item(50960, "magnesium", 0.5, 5),
    Item(50971, "potassium", 1.5, 10),
    Item(50970, "phosphate", 0.5, 10),
    Item(51006, "bun", 1, 150),
    Item(51221, "hematocrit", 5, 65),
    Item(51222, "hemoglobin", 2, 22),
    Item(51248, "mch", 15, 45),
    Item(51249, "mchc", 20, 45),
    Item(51250, "mcv", 50, 130),
    Item(51277, "rdw", 9, 35),
    Item(51279, "rbc", 1, 10),
    Item(51301, "wbc", 0.1, 80),
    Item(51265, "platelets", 5, 1500),
]

# Items of the severity score.
PAO2, BILIRUBIN, PLATELETS, CREATININE = 50821, 50885, 51265, 50912
SPO2, FIO2 = 220277, 223835
PRESSURE = [220052, 220181, 225312]
EYE, VERBAL, MOTOR = 220739, 223900, 223901
NOREPINEPHRINE = [221906, 30047, 30120]
EPINEPHRINE = [221289, 30044]
DOPAMINE = [221662, 30043]
DOBUTAMINE = [221653, 30042]
VASOPRESSIN = [222315]
URINE = [226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489]


def feature_names(items: list[Item]) -> list[str]:
    return list(dict.fromkeys(it.name for it in items))


VITAL_COLUMNS = [n + "_mean" for n in feature_names(VITALS)]
LAB_COLUMNS = [n + "_mean" for n in feature_names(LABS)]
SEVERITY_PARTS = ["sofa_resp", "sofa_cardio", "sofa_hepatic", "sofa_coag", "sofa_renal", "sofa_neuro"]
