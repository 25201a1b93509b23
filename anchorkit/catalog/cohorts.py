"""Cohort selection, code mapping and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorkit.catalog.registry import Register, clinical, r6
from anchorkit.functions import codes as C
from anchorkit.functions import values as V
from anchorkit.operators import cohort as co
from anchorkit.operators import encode as en
from anchorkit.plans.retail import clinical_views, spread, table
from anchorkit.session import staged

REGISTER = Register()


def stored_cohort(spark, sf):
    """(cohort, views): the cohort is written once because every extract reads it."""
    views = clinical_views(spark, sf)
    return staged(co.select_cohort(views["icustays"], views["patients"]), "cohort"), views


@REGISTER("first_stay_cohort", clinical("""
SELECT subject_id, hadm_id, stay_id, first_careunit, last_careunit, epoch_us(intime) AS in_us, epoch_us(outtime) AS out_us,
       round(los_hours, 6) AS los_hours, round(los_days, 6) AS los_days, gender, age FROM cohort ORDER BY subject_id, stay_id"""))
def first_stay_cohort(spark, sf):
    views = clinical_views(spark, sf)
    c = co.select_cohort(views["icustays"], views["patients"])
    return c.select("subject_id", "hadm_id", "stay_id", "first_careunit", "last_careunit", V.micros("intime").alias("in_us"),
                    V.micros("outtime").alias("out_us"), r6("los_hours"), r6("los_days"), "gender", "age",
                    ).orderBy("subject_id", "stay_id")


@REGISTER("all_stays_cohort", clinical("""
SELECT stay_id, i.subject_id, round((epoch_us(outtime) - epoch_us(intime)) / 86400000000.0::DOUBLE, 6) AS los_days
FROM icustays i JOIN patients p ON i.subject_id = p.subject_id
WHERE epoch_us(outtime) - epoch_us(intime) >= 12 * 3600000000 AND epoch_us(outtime) - epoch_us(intime) <= 20 * 86400000000
  AND anchor_age >= 40"""))
def all_stays_cohort(spark, sf):
    """Every stay, bounds from the configuration instead of the defaults."""
    views = clinical_views(spark, sf)
    c = co.select_cohort(views["icustays"], views["patients"], min_age=40, min_hours=12, max_days=20, first_only=False)
    return c.select("stay_id", "subject_id", r6("los_days"))


@REGISTER("outcome_classes", clinical("""
SELECT stay_id, round(ln(1 + los_days), 6) AS los_log,
       CASE WHEN los_days <= 2 THEN 0 WHEN los_days > 7 THEN 2 ELSE 1 END AS los_class,
       round(greatest(0, exp(ln(1 + los_days) - 0.5) - 1), 6) AS back_days FROM cohort"""))
def outcome_classes(spark, sf):
    views = clinical_views(spark, sf)
    out = co.add_outcomes(co.select_cohort(views["icustays"], views["patients"]))
    return out.select("stay_id", r6("los_log"), "los_class", r6(V.days_from_log(F.col("los_log") - 0.5), "back_days"))


@REGISTER("demographic_flags", clinical("""
SELECT stay_id, age::DOUBLE AS age, CASE WHEN upper(gender) = 'M' THEN 1 ELSE 0 END AS gender_male FROM cohort"""))
def demographic_flags(spark, sf):
    views = clinical_views(spark, sf)
    return co.demographics(co.select_cohort(views["icustays"], views["patients"]))


# Half-open ranges of codes (their first characters) and chapters; other codes are chapter 0.
CHAPTER_RANGES = [
    ("A", "C", 1), ("C", "D", 2), ("D0", "D5", 2), ("D5", "D9", 3), ("E", "F", 4), ("F", "G", 5), ("G", "H", 6), ("H0", "H6", 7),
    ("H6", "H:", 8), ("I", "J", 9), ("J", "K", 10), ("K", "L", 11), ("L", "M", 12), ("M", "N", 13), ("N", "O", 14), ("O", "P", 15),
    ("P", "Q", 16), ("Q", "R", 17), ("R", "S", 18), ("S", "U", 19), ("U", "V", 22), ("V", "Z", 20), ("Z", "[", 21),
]
CHAPTER_SQL = ("coalesce((SELECT max(chapter) FROM (VALUES " + ", ".join(map(str, CHAPTER_RANGES))
               + ") AS r(low, high, chapter) WHERE {c} >= low AND {c} < high), 0)")


@REGISTER("code_chapters", f"""
SELECT code, {CHAPTER_SQL.format(c="upper(trim(code))")} AS chapter, n FROM (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE
           repeat(' ', (l_linenumber % 3)::INT) || CASE WHEN l_suppkey % 2 = 0 THEN lower(chr((60 + l_partkey % 35)::INT)) ELSE chr((60 + l_partkey % 35)::INT) END
           || (l_suppkey % 10)::VARCHAR || ' ' END AS code, count(*) AS n FROM lineitem GROUP BY 1)""")
def code_chapters(spark, sf):
    letter = F.char(60 + F.col("l_partkey") % 35)
    code = F.concat(F.repeat(F.lit(" "), (F.col("l_linenumber") % 3).cast("int")),
                    F.when(F.col("l_suppkey") % 2 == 0, F.lower(letter)).otherwise(letter),
                    (F.col("l_suppkey") % 10).cast("string"), F.lit(" "))
    counted = table(spark, sf, "lineitem").groupBy(F.when(F.col("l_linenumber") != 7, code).alias("code")).agg(
        F.count(F.lit(1)).alias("n"))
    return counted.select("code", C.code_chapter("code").alias("chapter"), "n")


@REGISTER("top_two_chapters", clinical(f"""
SELECT hadm_id, max(CASE WHEN rn = 1 THEN chapter END) AS diag1_chapter, max(CASE WHEN rn = 2 THEN chapter END) AS diag2_chapter
FROM (SELECT hadm_id, {CHAPTER_SQL.format(c="icd_code")} AS chapter,
             row_number() OVER (PARTITION BY hadm_id ORDER BY seq_num, icd_code) AS rn FROM diagnoses WHERE icd_version = 10)
WHERE rn <= 2 GROUP BY hadm_id"""))
def top_two_chapters(spark, sf):
    return en.top_chapters(clinical_views(spark, sf)["diagnoses_icd"])


@REGISTER("diagnosis_extract", clinical(f"""
SELECT subject_id, hadm_id, any_value(chapter) FILTER (rn = 1) AS diag1_chapter, any_value(chapter) FILTER (rn = 2) AS diag2_chapter
FROM (SELECT subject_id, hadm_id, {CHAPTER_SQL.format(c="icd_code")} AS chapter,
             row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY seq_num, icd_code) AS rn FROM diagnoses WHERE icd_version = 10)
GROUP BY subject_id, hadm_id"""))
def diagnosis_extract(spark, sf):
    """The chapters by subject and admission."""
    return en.top_chapters(clinical_views(spark, sf)["diagnoses_icd"], subject="subject_id")


UNIT_NAMES = {"NATION_1": "N1", "NATION_3": "N3", "NATION_7": "N1", "NATION_11": "Far"}


@REGISTER("rare_units_grouped", """
WITH named AS (SELECT c_custkey, CASE n_name WHEN 'NATION_1' THEN 'N1' WHEN 'NATION_3' THEN 'N3' WHEN 'NATION_7' THEN 'N1'
                 WHEN 'NATION_11' THEN 'Far' ELSE n_name END AS unit FROM customer JOIN nation ON c_nationkey = n_nationkey),
top AS (SELECT unit FROM named GROUP BY unit ORDER BY count(*) DESC, unit LIMIT 8)
SELECT CASE WHEN unit IN (SELECT unit FROM top) THEN unit ELSE 'Other' END AS unit, count(*) AS n FROM named GROUP BY 1""")
def rare_units_grouped(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = table(spark, sf, "customer").join(nation, "c_nationkey").select(
        "c_custkey", C.unit_label(F.concat(F.lit("  "), "n_name"), UNIT_NAMES).alias("unit"))
    return en.group_rare(named, "unit", 8).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@REGISTER("segment_one_hot", """
SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS "seg_BUILDING", (c_mktsegment = 'FURNITURE')::INT AS "seg_FURNITURE",
       (c_mktsegment = 'HOUSEHOLD')::INT AS "seg_HOUSEHOLD", (c_mktsegment = 'MACHINERY')::INT AS "seg_MACHINERY" FROM customer""")
def segment_one_hot(spark, sf):
    customers = table(spark, sf, "customer")
    return customers.select("c_custkey", *en.one_hot("c_mktsegment", en.levels_of(customers, "c_mktsegment"), "seg"))


# Fixed values: (place, label, text); of the texts that occur in the upper-cased input the first place names the label.
TYPE_TEXTS = [(1, "Elective", "ELECTIVE"), (1, "Elective", "SURGICAL SAME DAY"), (2, "Urgent", "URGENT"), (3, "Emergency", "EMER"),
              (3, "Emergency", "EW ")]
PLACE_TEXTS = [(1, "Emergency Room", "EMERGENCY"), (2, "Transfer from SNF", "SNF"), (2, "Transfer from SNF", "SKILLED"),
               (3, "Transfer from Hospital", "TRANSFER"), (3, "Transfer from Hospital", "HOSPITAL"), (4, "Clinic Referral", "CLINIC"),
               (5, "Physician Referral", "PHYSICIAN"), (6, "Walk-in/Self Referral", "WALK"), (6, "Walk-in/Self Referral", "SELF")]


def _first_text(rules):
    return ("coalesce((SELECT arg_min(label, place) FROM (VALUES " + ", ".join(map(str, rules))
            + ") AS r(place, label, part) WHERE contains(upper({c}), part)), 'Other')")


TYPE_SQL, PLACE_SQL = _first_text(TYPE_TEXTS), _first_text(PLACE_TEXTS)


@REGISTER("text_labels", f"""
SELECT doc_id, {TYPE_SQL.format(c='text')} AS kind, {PLACE_SQL.format(c='text')} AS place FROM documents""")
def text_labels(spark, sf):
    """The substring rules over whole document texts."""
    return spread(table(spark, sf, "documents")).select(
        "doc_id", C.admission_type("text").alias("kind"), C.admission_location("text").alias("place"))


@REGISTER("admission_labels", clinical(f"""
SELECT {TYPE_SQL.format(c='admission_type')} AS kind, {PLACE_SQL.format(c='admission_location')} AS place, count(*) AS n
FROM icustays LEFT JOIN admissions USING (hadm_id) GROUP BY 1, 2"""))
def admission_labels(spark, sf):
    views = clinical_views(spark, sf)
    joined = en.with_admissions(views["icustays"].select("stay_id", "hadm_id"), views["admissions"])
    return joined.groupBy(C.admission_type("admission_type").alias("kind"),
                          C.admission_location("admission_location").alias("place")).agg(F.count(F.lit(1)).alias("n"))


UNITS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TYPES = ["Other", "Urgent"]
PLACES = ["Clinic Referral", "Emergency Room", "Other", "Physician Referral", "Transfer from Hospital", "Transfer from SNF",
          "Walk-in/Self Referral"]


def one_hot_sql() -> str:
    """Encoded columns over (first_careunit, kind, place, d1, d2); the first level of a set is dropped."""
    cols = [f"""(first_careunit = '{u}')::INT AS "first_careunit_{u}\"""" for u in UNITS[1:]]
    cols += [f"""(kind = '{t}')::INT AS "admission_type_{t}\"""" for t in TYPES[1:]]
    cols += [f"""(place = '{p}')::INT AS "admission_location_{p}\"""" for p in PLACES[1:]]
    cols += [f"(coalesce({d}, 0) = {k})::INT AS {d}_ch_{k}" for d in ("diag1", "diag2") for k in range(1, 23)]
    return ", ".join(cols)


ADMIN_SQL = f"""
ranked AS (SELECT hadm_id, {CHAPTER_SQL.format(c="icd_code")} AS chapter,
             row_number() OVER (PARTITION BY hadm_id ORDER BY seq_num, icd_code) AS rn FROM diagnoses WHERE icd_version = 10),
chapters AS (SELECT hadm_id, max(CASE WHEN rn = 1 THEN chapter END) AS diag1, max(CASE WHEN rn = 2 THEN chapter END) AS diag2
             FROM ranked GROUP BY hadm_id),
labelled AS (SELECT c.stay_id, c.first_careunit, {TYPE_SQL.format(c='admission_type')} AS kind,
                    {PLACE_SQL.format(c='admission_location')} AS place, diag1, diag2
             FROM cohort c LEFT JOIN admissions a ON a.hadm_id = c.hadm_id LEFT JOIN chapters h ON h.hadm_id = c.hadm_id),
administrative AS (SELECT stay_id, {one_hot_sql()} FROM labelled)"""


@REGISTER("administrative_columns", clinical("SELECT * FROM administrative", ADMIN_SQL))
def administrative_columns(spark, sf):
    cohort, views = stored_cohort(spark, sf)
    return en.administrative(cohort, views["diagnoses_icd"], views["admissions"])


@REGISTER("sparse_levels", """
SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_partkey) - 1 AS level, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_levels FROM lineitem""")
def sparse_levels(spark, sf):
    """Every part is a level: numbers and sparse vectors instead of a column per part."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    hot = en.sparse_one_hot(lines, "l_partkey", drop_first=False)
    # the vector's own fields: the place of its one and its width
    parts = F.from_json(F.to_json(F.struct("hot")), "hot struct<size: bigint, indices: array<bigint>>")["hot"]
    return hot.select("l_orderkey", "l_linenumber", parts["indices"][0].alias("level"), parts["size"].alias("n_levels"))
