"""Clinical fixtures: small tables with known answers."""

from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from anchorkit.functions import codes as C
from anchorkit.functions import scores as S
from anchorkit.operators import cohort as co
from anchorkit.operators import encode as en
from anchorkit.operators.occupancy import occupancy
from anchorkit.operators.quality import check_signals
from anchorkit.operators.windows import EventSchema, Item, window_means
from anchorkit.plans import clinical as cl
from anchorkit.session import bucketed

DAY = dt(2020, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


@pytest.fixture(scope="module")
def people(spark):
    cohort = spark.createDataFrame(
        [(10, 100, 65, "M", "Medical Intensive Care Unit (MICU)"), (20, 200, 44, "F", "Surgical Intensive Care Unit (SICU)")],
        "stay_id long, hadm_id long, age int, gender string, first_careunit string")
    admissions = spark.createDataFrame(
        [(100, "EW EMER.", "EMERGENCY ROOM"), (200, "ELECTIVE", "PHYSICIAN REFERRAL")],
        "hadm_id long, admission_type string, admission_location string")
    diagnoses = spark.createDataFrame(
        [(100, "A419", 10, 1), (100, "I219", 10, 2), (200, "J189", 10, 1), (200, "N179", 10, 2)],
        "hadm_id long, icd_code string, icd_version int, seq_num int")
    return cohort, admissions, diagnoses


def test_demographics(people):
    rows = {r.stay_id: r for r in co.demographics(people[0]).collect()}
    assert rows[10].gender_male == 1 and rows[20].gender_male == 0 and rows[10].age == 65.0


def test_demographics_needs_columns(people):
    with pytest.raises(KeyError):
        co.demographics(people[0].drop("gender"))


def test_administrative_columns(people):
    out = en.administrative(people[0], people[2], people[1])
    rows = {r.stay_id: r.asDict() for r in out.collect()}
    assert rows[10]["diag1_ch_1"] == 1 and rows[10]["diag2_ch_9"] == 1 and rows[20]["diag1_ch_10"] == 1
    assert rows[20]["first_careunit_SICU"] == 1 and "first_careunit_MICU" not in out.columns
    assert rows[10]["admission_type_Emergency"] == 1 and "admission_type_Elective" not in out.columns
    assert sum(c.startswith("diag") for c in out.columns) == 44


def test_administrative_without_admissions(people):
    out = en.administrative(people[0], people[2])
    assert not [c for c in out.columns if c.startswith("admission_")]  # one label 'Other', dropped


def test_single_diagnosis_and_ready_chapters(spark):
    raw = spark.createDataFrame([(1, "I10", 10, 1), (2, "E11", 9, 1)], "hadm_id long, icd_code string, icd_version int, seq_num int")
    assert [tuple(r) for r in en.top_chapters(raw).collect()] == [(1, 9, None)]
    ready = spark.createDataFrame([(1, 2, 3, 4)], "hadm_id long, diag1_chapter int, diag2_chapter int, other int")
    assert en.top_chapters(ready).columns == ["hadm_id", "diag1_chapter", "diag2_chapter"]


@pytest.mark.parametrize("code, chapter", [
    ("A41", 1), ("b20", 1), ("C50", 2), ("D49", 2), ("D50", 3), ("D89", 3), ("D90", 0), ("E11", 4), ("F32", 5), ("G40", 6),
    ("H59", 7), ("H60", 8), ("H9", 8), ("H", 0), ("D", 0), (" i219 ", 9), ("J18", 10), ("K70", 11), ("L03", 12), ("M54", 13),
    ("N17", 14), ("O80", 15), ("P07", 16), ("Q21", 17), ("R07", 18), ("S72", 19), ("T40", 19), ("V43", 20), ("W19", 20),
    ("X59", 20), ("Y83", 20), ("Z51", 21), ("U07", 22), ("", 0), ("  ", 0), ("250", 0), (None, 0), ("\tK5\n", 11)])
def test_chapters(spark, code, chapter):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(C.code_chapter("c").alias("k")).first().k == chapter


def test_labels(spark):
    df = spark.createDataFrame([("Surgical same day admission", "Transfer from skilled nursing"), ("URGENT ELECTIVE", "Self"),
                                ("Urgent emergency", "clinic hospital"), (None, None)], "a string, b string")
    out = [tuple(r) for r in df.select(C.admission_type("a"), C.admission_location("b")).collect()]
    assert out == [("Elective", "Transfer from SNF"), ("Elective", "Walk-in/Self Referral"), ("Urgent", "Transfer from Hospital"),
                   ("Other", "Other")]


def test_first_day_means(spark):
    cohort = spark.createDataFrame([(1, 100, DAY)], "stay_id long, hadm_id long, intime timestamp_ntz")
    chart = spark.createDataFrame(
        [(1, 220045, at(1), 80.0), (1, 220045, at(2), 100.0), (1, 223761, at(3), 98.6), (1, 220045, at(26), 120.0)],
        "stay_id long, itemid int, charttime timestamp_ntz, valuenum double")
    lab = spark.createDataFrame([(100, 50912, at(1), 1.0), (100, 50912, at(3), 2.0), (100, 50931, at(26), 100.0)],
                                "hadm_id long, itemid int, charttime timestamp_ntz, valuenum double")
    v, l = cl.vitals(cohort, chart).first(), cl.labs(cohort, lab).first()
    assert v.heart_rate_mean == 90 and round(v.temperature_mean, 1) == 37.0
    assert l.creatinine_mean == 1.5 and l.glucose_mean is None
    assert cl.vitals(cohort, precomputed=spark.createDataFrame([(1, 70.0)], "stay_id long, heart_rate_mean double")).first().spo2_mean is None
    with pytest.raises(ValueError):
        cl.vitals(cohort)
    with pytest.raises(KeyError):
        cl.labs(cohort, lab.drop("valuenum"))


def test_window_edges_ranges_and_all_invalid_entity(spark):
    cohort = spark.createDataFrame([(1, DAY), (2, DAY), (3, None)], "stay_id long, intime timestamp_ntz")
    rows = [(1, 7, at(0), 10.0), (1, 7, at(24), 20.0), (1, 7, at(24) + timedelta(microseconds=1), 90.0), (1, 7, at(1), None),
            (1, 7, at(1), 101.0), (1, 7, at(-1), 50.0), (2, 7, at(1), 500.0), (3, 7, at(1), 5.0)]
    ev = spark.createDataFrame(rows, "stay_id long, itemid int, charttime timestamp_ntz, valuenum double")
    out = window_means(ev, cohort, [Item(7, "x", 10, 100), Item(8, "y", 0, 1)], EventSchema()).collect()
    assert [tuple(r) for r in out] == [(1, 15.0, None)]


def test_occupancy(spark):
    rows = [(1, "MICU", at(0), at(10)), (2, "MICU", at(1), at(5)), (3, "MICU", at(5), at(8)), (4, "MICU", at(5), at(6)),
            (5, "SICU", at(5), at(7))]
    stays = spark.createDataFrame(rows, "stay_id long, first_careunit string, intime timestamp_ntz, outtime timestamp_ntz")
    got = {r.stay_id: r for r in occupancy(stays).collect()}
    assert [got[i].concurrent_patients for i in range(1, 6)] == [0, 1, 2, 2, 0]
    assert all(0 <= r.occupancy_percentile <= 1 and 0 <= r.occupancy_rate <= 1 for r in got.values())


def test_occupancy_against_pairs(spark):
    """Random stays with ties, zero and negative lengths, open ends and a missing unit."""
    import random

    rnd, rows = random.Random(5), []
    for i in range(300):
        start = rnd.randrange(0, 40)
        end = None if i % 29 == 0 else at(start + rnd.randrange(-1, 12))
        rows.append((i, None if i % 17 == 0 else f"U{min(i % 9, 2)}", at(start), end))
    stays = spark.createDataFrame(rows, "stay_id long, first_careunit string, intime timestamp_ntz, outtime timestamp_ntz")
    got = {r.stay_id: r.concurrent_patients for r in occupancy(stays).collect()}
    want = {i: sum(1 for j, v, s, e in rows if j != i and v == u and e is not None and s <= t < e) for i, u, t, _ in rows}
    assert got == want


def stay_table(spark, rows):
    return spark.createDataFrame(rows, "subject_id long, hadm_id long, stay_id long, first_careunit string, last_careunit string, "
                                       "intime timestamp_ntz, outtime timestamp_ntz")


def test_cohort_rules(spark):
    stays = stay_table(spark, [
        (1, 1, 1, "U", "U", at(0), at(2)), (1, 2, 2, "U", "U", at(50), at(90)),       # first stay too short: subject is out
        (2, 3, 3, "U", "U", at(5), at(9)), (2, 4, 4, "U", "U", at(5), at(60)),        # tie: lower stay id; 4 h is enough
        (3, 5, 5, "U", "U", at(0), at(720)), (4, 6, 6, "U", "U", at(0), at(720.1)),   # 30 days is the limit
        (5, 7, 7, "U", "U", None, at(9)), (5, 8, 8, "U", "U", at(1), at(9)),          # a missing start sorts last
        (6, 9, 9, "U", "U", at(0), at(9)), (7, 10, 10, "U", "U", at(0), at(9))])
    patients = spark.createDataFrame([(1, "M", 40), (2, "F", 18), (3, "M", 50), (4, "M", 50), (5, "F", 30), (6, "M", 17)],
                                     "subject_id long, gender string, anchor_age int")
    assert sorted(r.stay_id for r in co.select_cohort(stays, patients).collect()) == [3, 5, 8]
    everyone = co.select_cohort(stays, patients, first_only=False, min_age=0)
    assert sorted(r.stay_id for r in everyone.collect()) == [2, 3, 4, 5, 8, 9]
    given = co.select_cohort(stays.withColumn("los", F.lit("2.5")), patients, los="los")
    assert {r.los_days for r in given.collect()} == {2.5}


def test_outcomes(spark):
    df = spark.createDataFrame([(2.0,), (2.1,), (7.0,), (7.1,), (None,)], "los_days double")
    assert [r.los_class for r in co.add_outcomes(df).collect()] == [0, 1, 1, 2, 1]


@pytest.mark.parametrize("fn, args, want", [
    (S.hepatic, [(12.0, 4), (11.9, 3), (6.0, 3), (2.0, 2), (1.2, 1), (1.1, 0), (None, 0)], None),
    (S.coagulation, [(19.9, 4), (20.0, 3), (50.0, 2), (100.0, 1), (150.0, 0), (None, 0)], None),
    (S.neurological, [(5.0, 4), (6.0, 3), (10.0, 2), (13.0, 1), (15.0, 0), (None, 0)], None)])
def test_single_bands(spark, fn, args, want):
    df = spark.createDataFrame([(v,) for v, _ in args], "v double")
    assert [r[0] for r in df.select(fn(F.col("v"))).collect()] == [w for _, w in args]


def test_combined_bands(spark):
    rows = [(3.5, None, 3), (1.0, 199.0, 4), (5.0, 900.0, 4), (None, 499.0, 3), (2.0, 500.0, 2), (1.2, None, 1), (None, None, 0)]
    df = spark.createDataFrame(rows, "c double, u double, want int")
    assert all(r.got == r.want for r in df.select("want", S.renal(F.col("c"), F.col("u")).alias("got")).collect())
    rows = [(16.0, None, None, None, None, 4), (None, 0.2, None, None, None, 4), (6.0, None, None, None, None, 3),
            (None, None, 0.05, None, None, 3), (5.0, None, None, None, None, 2), (None, None, None, 1, None, 2),
            (None, None, None, None, 69.9, 1), (None, None, None, None, 70.0, 0), (None, None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "d double, e double, n double, v int, m double, want int")
    got = df.select("want", S.cardiovascular(*[F.col(c) for c in "denvm"]).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    rows = [(90.0, 98.0, 100.0, 90.0), (None, 97.0, 0.5, (97 / 0.5 - 64) / 0.84), (None, 98.0, 0.5, None), (80.0, None, 0.0, None),
            (80.0, None, None, None), (80.0, None, 1.0, 80.0)]
    df = spark.createDataFrame(rows, "p double, s double, f double, want double")
    for r in df.select("want", S.oxygen_ratio(F.col("p"), F.col("s"), F.col("f")).alias("got")).collect():
        assert r.got == (None if r.want is None else pytest.approx(r.want))


def severity_inputs(spark):
    cohort = spark.createDataFrame([(1, 11, DAY), (2, 22, DAY), (3, 33, DAY)], "stay_id long, hadm_id long, intime timestamp_ntz")
    chart = spark.createDataFrame([
        (1, 220277, at(1), 90.0), (1, 220277, at(1), 40.0), (1, 223835, at(2), 50.0), (1, 220052, at(1), 60.0),
        (1, 220739, at(1), 3.0), (1, 223900, at(1.5), 4.0), (1, 223901, at(0.5), 5.0),      # exactly 30 minutes apart
        (1, 223900, at(1.51), 1.0), (1, 220739, at(10), 1.0),                                # too far, or alone
        (2, 220739, at(25), 1.0), (2, 223900, at(25), 1.0), (2, 223901, at(25), 1.0)],       # outside the window
        "stay_id long, itemid int, charttime timestamp_ntz, valuenum double")
    lab = spark.createDataFrame([(11, 50885, at(24), 6.0), (11, 51265, at(1), 120.0), (11, 50912, at(1), 2.5), (11, 50912, at(1), 25.0),
                                 (22, 50821, at(1), 80.0)], "hadm_id long, itemid int, charttime timestamp_ntz, valuenum double")
    inputs = spark.createDataFrame([(2, 222315, at(3), None), (1, 221906, at(30), 1.0)],
                                   "stay_id long, itemid int, starttime timestamp_ntz, rate double")
    outputs = spark.createDataFrame([(1, 226559, at(1), 300.0), (1, 226560, at(2), 300.0)],
                                    "stay_id long, itemid int, charttime timestamp_ntz, value double")
    return cohort, chart, lab, inputs, outputs


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_severity(spark, max_bytes):
    rows = {r.stay_id: r for r in cl.severity_score(*severity_inputs(spark), max_bytes=max_bytes).collect()}
    one = rows[1]
    # (90 / 0.5 - 64) / 0.84 = 138 -> 3; pressure 60 -> 1; bilirubin 6 -> 3; platelets 120 -> 1; creatinine 2.5 -> 2; 3+4+5 = 12 -> 2
    assert (one.sofa_resp, one.sofa_cardio, one.sofa_hepatic, one.sofa_coag, one.sofa_renal, one.sofa_neuro) == (3, 1, 3, 1, 2, 2)
    assert one.sofa_total == 12 and one.urine_24h == 600 and one.bilirubin_max == 6
    assert rows[2].sofa_cardio == 2 and rows[2].sofa_neuro == 0 and rows[2].sofa_resp == 0
    assert rows[3].sofa_total == 0 and rows[3].urine_24h is None


def test_dead_signals(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 3, None)], "a int, b int, c double")
    assert check_signals(df, ["a", "b"], ["c", "d"], strict=False) == ["a: constant", "c: all missing", "d: absent"]
    with pytest.raises(ValueError):
        check_signals(df, ["a"], [])
    assert check_signals(df, ["b"], ["a"]) == []


def test_base_and_extended_features(spark, people):
    cohort, admissions, diagnoses = people
    full = cohort.withColumns({"subject_id": F.col("stay_id") + 1, "intime": F.lit(DAY).cast("timestamp_ntz"), "los_days": F.lit(3.0),
                               "outtime": F.lit(at(72)).cast("timestamp_ntz"), "los_hours": F.lit(72.0)})
    chart = spark.createDataFrame([(10, 220045, at(1), 80.0)], "stay_id long, itemid int, charttime timestamp_ntz, valuenum double")
    lab = spark.createDataFrame([], "hadm_id long, itemid int, charttime timestamp_ntz, valuenum double")
    base = cl.base_features({"admissions": admissions, "diagnoses_icd": diagnoses, "chartevents": chart, "labevents": lab}, cohort=full)
    rows = {r.stay_id: r for r in base.collect()}
    assert len(rows) == 2 and rows[20].heart_rate_mean is None and rows[10].los_class == 1
    extra = spark.createDataFrame([(10, 5)], "stay_id long, sofa_total int")
    assert {r.stay_id: r.sofa_total for r in cl.extended_features(base, extra).collect()} == {10: 5, 20: None}
    with pytest.raises(KeyError):
        cl.extended_features(base.drop("stay_id"), extra)
    assert "occupancy_rate" in cl.with_occupancy(base, full).columns


def test_features_above_the_store_need_no_exchange(spark):
    """Events, labels and cohort lie in buckets of the stay: vitals, labs, score, alignment and joins stay where they are."""
    cohort, chart, lab, inputs, outputs = severity_inputs(spark)
    tables = {"chartevents": chart, "labevents": lab, "inputevents": inputs, "outputevents": outputs}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = cl.event_store(cohort, tables)
        people = bucketed(cohort, "stay_id", "people")
        wide = people.join(cl.feature_means(store), "stay_id", "left").join(cl.severity_from(people, store), "stay_id", "left")
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") >= 3
        rows = {r.stay_id: r for r in wide.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows[1].sofa_total == 12 and rows[1].spo2_mean == 90.0 and rows[1].platelets_mean == 120.0 and rows[3].creatinine_mean is None
