"""Column types of the source tables; columns not listed are read as text."""

from __future__ import annotations

# Table -> columns with types.
TABLE_TYPES = {
    "icustays": {
        "subject_id": "bigint", "hadm_id": "bigint", "stay_id": "bigint", "first_careunit": "string",
        "last_careunit": "string", "intime": "timestamp_ntz", "outtime": "timestamp_ntz", "los": "double",
    },
    "patients": {"subject_id": "bigint", "gender": "string", "anchor_age": "int"},
    "admissions": {"subject_id": "bigint", "hadm_id": "bigint", "admission_type": "string", "admission_location": "string"},
    "diagnoses_icd": {
        "subject_id": "bigint", "hadm_id": "bigint", "seq_num": "int", "icd_code": "string", "icd_version": "int",
    },
    "d_icd_diagnoses": {"icd_code": "string", "icd_version": "int", "long_title": "string"},
    "d_items": {"itemid": "int", "label": "string"},
    "d_labitems": {"itemid": "int", "label": "string"},
    "chartevents": {
        "subject_id": "bigint", "hadm_id": "bigint", "stay_id": "bigint", "charttime": "timestamp_ntz",
        "itemid": "int", "valuenum": "double",
    },
    "labevents": {
        "subject_id": "bigint", "hadm_id": "bigint", "itemid": "int", "charttime": "timestamp_ntz", "valuenum": "double",
    },
    "inputevents": {
        "subject_id": "bigint", "hadm_id": "bigint", "stay_id": "bigint", "caregiver_id": "int",
        "starttime": "timestamp_ntz", "endtime": "timestamp_ntz", "storetime": "timestamp_ntz", "itemid": "int",
        "amount": "double", "amountuom": "string", "rate": "double", "rateuom": "string", "orderid": "int",
        "linkorderid": "int", "ordercategoryname": "string", "secondaryordercategoryname": "string",
        "ordercomponenttypedescription": "string", "ordercategorydescription": "string", "patientweight": "double",
        "totalamount": "double", "totalamountuom": "string", "isopenbag": "smallint", "continueinnextdept": "smallint",
        "statusdescription": "string", "originalamount": "double", "originalrate": "double",
    },
    "outputevents": {
        "subject_id": "bigint", "hadm_id": "bigint", "stay_id": "bigint", "caregiver_id": "int",
        "charttime": "timestamp_ntz", "storetime": "timestamp_ntz", "itemid": "int", "value": "double", "valueuom": "string",
    },
}

# Tables of the hospital schema; all others belong to the unit schema.
HOSPITAL_TABLES = ["admissions", "patients", "diagnoses_icd", "d_icd_diagnoses", "labevents", "d_labitems"]
