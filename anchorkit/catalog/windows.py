"""Anchored windows, aligned series, occupancy and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorkit.catalog.cohorts import ADMIN_SQL, stored_cohort
from anchorkit.catalog.registry import Register, clinical, r6, round_doubles
from anchorkit.functions import scores as S
from anchorkit.functions import values as V
from anchorkit.operators import windows as wi
from anchorkit.operators.align import band_aligned_min
from anchorkit.operators.cohort import keep_first
from anchorkit.operators.occupancy import occupancy
from anchorkit.plans import clinical as cl
from anchorkit.plans import items as I
from anchorkit.plans.retail import clinical_views, table
from anchorkit.session import staged

REGISTER = Register()
ACTIONS = ["signup", "purchase", "error", "view", "click"]
EVENTS = wi.EventSchema("user_id", "event_type", "ts", "value")


def _first_events(events):
    first = keep_first(events.select("user_id", "ts", "event_id"), ["user_id"], [F.col("ts").asc_nulls_last(), F.col("event_id")])
    return first.select("user_id", F.col("ts").alias("anchor"))


@REGISTER("first_window_means", """
WITH first AS (SELECT user_id, min(ts) AS anchor FROM events GROUP BY user_id)
SELECT e.user_id, """ + ", ".join(
    f"round(avg(CASE WHEN event_type = '{a}' THEN value END), 6) AS {a}_mean" for a in ACTIONS) + """
FROM events e JOIN first f ON e.user_id = f.user_id
WHERE ts >= anchor AND ts <= anchor + INTERVAL 24 HOUR AND value BETWEEN 1 AND 200 GROUP BY e.user_id""")
def first_window_means(spark, sf):
    events = table(spark, sf, "events")
    means = wi.window_means(events, _first_events(events), [wi.Item(a, a, 1, 200) for a in ACTIONS], EVENTS,
                            entity="user_id", anchor="anchor")
    return round_doubles(means)


def _case_means(names, items, cast=""):
    cols = []
    for name in names:
        same = [it for it in items if it.name == name]
        whens = " ".join(
            f"WHEN itemid = {it.item} AND valuenum BETWEEN {it.low} AND {it.high} THEN "
            + ("(valuenum - 32.0::DOUBLE) * 5.0::DOUBLE / 9.0::DOUBLE" if it.convert == "f_to_c" else "valuenum") for it in same)
        cols.append(f"avg(CASE {whens} END) AS {name}_mean")
    return ", ".join(cols)


def _any_valid(items):
    return " OR ".join(f"(itemid = {it.item} AND valuenum BETWEEN {it.low} AND {it.high})" for it in items)


WINDOW = "charttime >= intime AND charttime <= intime + INTERVAL 24 HOUR"
VITALS_SQL = f"""vital_means AS (
SELECT c.stay_id, {_case_means(I.feature_names(I.VITALS), I.VITALS)}
FROM chartevents e JOIN cohort c ON e.stay_id = c.stay_id WHERE {WINDOW} AND ({_any_valid(I.VITALS)}) GROUP BY c.stay_id)"""
LABS_SQL = f"""lab_means AS (
SELECT c.stay_id, {_case_means(I.feature_names(I.LABS), I.LABS)}
FROM labevents e JOIN cohort c ON e.hadm_id = c.hadm_id WHERE {WINDOW} AND ({_any_valid(I.LABS)}) GROUP BY c.stay_id)"""


def _rounded(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@REGISTER("vital_means", clinical(f"SELECT stay_id, {_rounded(I.VITAL_COLUMNS)} FROM vital_means", VITALS_SQL))
def vital_means(spark, sf):
    cohort, views = stored_cohort(spark, sf)
    return round_doubles(cl.vitals(cohort, views["chartevents"]))


@REGISTER("lab_means", clinical(f"SELECT stay_id, {_rounded(I.LAB_COLUMNS)} FROM lab_means", LABS_SQL))
def lab_means(spark, sf):
    cohort, views = stored_cohort(spark, sf)
    return round_doubles(cl.labs(cohort, views["labevents"]))


@REGISTER("precomputed_labs", clinical(
    "SELECT c.stay_id, " + ", ".join(f"round(m.{n}, 6) AS {n}" for n in I.LAB_COLUMNS)
    + " FROM cohort c LEFT JOIN lab_means m ON m.stay_id = c.stay_id", LABS_SQL))
def precomputed_labs(spark, sf):
    """Admission-level means moved to stays; stays without labs keep a row."""
    cohort, views = stored_cohort(spark, sf)
    by_admission = wi.window_means(views["labevents"], cohort, I.LABS, cl.LAB, entity="hadm_id")
    return round_doubles(cl.labs(cohort, precomputed=by_admission))


@REGISTER("precomputed_vitals", clinical(
    "SELECT stay_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in I.VITAL_COLUMNS[:-1]) + f", NULL::DOUBLE AS {I.VITAL_COLUMNS[-1]} FROM vital_means",
    VITALS_SQL))
def precomputed_vitals(spark, sf):
    """Stored vital means of which a column is missing: it comes back empty."""
    cohort, views = stored_cohort(spark, sf)
    stored = staged(cl.vitals(cohort, views["chartevents"]).drop(I.VITAL_COLUMNS[-1]), "vitals")
    return round_doubles(cl.vitals(cohort, precomputed=stored))


@REGISTER("mergeable_means", "SELECT user_id, " + ", ".join(
    f"round(avg(CASE WHEN event_type = '{a}' THEN value END), 6) AS {a}_mean" for a in ACTIONS) + " FROM events GROUP BY user_id")
def mergeable_means(spark, sf):
    """Daily partial sums, merged over days, finished to means."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = wi.partial_means(events, ["day", "user_id", "event_type"])
    merged = wi.merge_partials(daily, ["user_id", "event_type"])
    return round_doubles(wi.finish_means(merged, "user_id", "event_type", ACTIONS))


@REGISTER("band_aligned_min", """
SELECT b.user_id, round(min(b.value + v.value + w.value), 6) AS aligned_min
FROM events b
JOIN events v ON v.user_id = b.user_id AND v.event_type = 'view'
  AND v.ts BETWEEN b.ts - INTERVAL 6 HOUR AND b.ts + INTERVAL 6 HOUR
JOIN events w ON w.user_id = b.user_id AND w.event_type = 'error'
  AND w.ts BETWEEN b.ts - INTERVAL 6 HOUR AND b.ts + INTERVAL 6 HOUR
WHERE b.event_type = 'click' GROUP BY b.user_id""")
def band_aligned(spark, sf):
    found = band_aligned_min(table(spark, sf, "events"), entity="user_id", item="event_type", time="ts", value="value",
                             base="click", others=["view", "error"], tolerance_seconds=6 * 3600)
    return round_doubles(found)


@REGISTER("occupancy_counts", clinical("""
SELECT stay_id, concurrent_patients,
       round(coalesce(concurrent_patients::DOUBLE / nullif(max(concurrent_patients) OVER (PARTITION BY first_careunit), 0), 0), 6) AS occupancy_rate,
       round(percent_rank() OVER (PARTITION BY first_careunit ORDER BY concurrent_patients), 6) AS occupancy_percentile
FROM counted""", """
counted AS (
  SELECT me.stay_id, me.first_careunit, count(o.stay_id) AS concurrent_patients
  FROM icustays me LEFT JOIN icustays o ON o.first_careunit = me.first_careunit AND o.stay_id <> me.stay_id
    AND o.intime <= me.intime AND me.intime < o.outtime
  GROUP BY me.stay_id, me.first_careunit)"""))
def occupancy_counts(spark, sf):
    return round_doubles(occupancy(clinical_views(spark, sf)["icustays"]))


# What each signal is read from (item, lowest and highest plausible value).
SIGNAL_ITEMS = [
    ("pao2", 50821, None, None), ("spo2", 220277, 50, 100), ("fio2", 223835, None, None), ("map", 220052, 0, 300), ("map", 220181, 0, 300),
    ("map", 225312, 0, 300), ("nore", 221906, None, None), ("nore", 30047, None, None), ("nore", 30120, None, None),
    ("epi", 221289, None, None), ("epi", 30044, None, None), ("dopa", 221662, None, None), ("dopa", 30043, None, None),
    ("vaso", 222315, None, None), ("bili", 50885, None, None), ("plate", 51265, None, None), ("creat", 50912, 0.1, 20),
]
# Bands of the score. A part scores the highest number among the bands that its signals meet, else 0.
SCORE_BANDS = [
    ("resp", "pf", "<", 100, 4), ("resp", "pf", "<", 200, 3), ("resp", "pf", "<", 300, 2), ("resp", "pf", "<", 400, 1),
    ("cardio", "dopa", ">", 15, 4), ("cardio", "dopa", ">", 5, 3), ("cardio", "dopa", "<=", 5, 2), ("cardio", "epi", ">", 0.1, 4),
    ("cardio", "epi", "<=", 0.1, 3), ("cardio", "nore", ">", 0.1, 4), ("cardio", "nore", "<=", 0.1, 3), ("cardio", "vaso", ">", 0, 2),
    ("cardio", "map", "<", 70, 1), ("hepatic", "bili", ">=", 12, 4), ("hepatic", "bili", ">=", 6, 3), ("hepatic", "bili", ">=", 2, 2),
    ("hepatic", "bili", ">=", 1.2, 1), ("coag", "plate", "<", 20, 4), ("coag", "plate", "<", 50, 3), ("coag", "plate", "<", 100, 2),
    ("coag", "plate", "<", 150, 1), ("renal", "creat", ">=", 5, 4), ("renal", "creat", ">=", 3.5, 3), ("renal", "creat", ">=", 2, 2),
    ("renal", "creat", ">=", 1.2, 1), ("renal", "urine", "<", 200, 4), ("renal", "urine", "<", 500, 3), ("neuro", "gcs", "<", 6, 4),
    ("neuro", "gcs", "<", 10, 3), ("neuro", "gcs", "<", 13, 2), ("neuro", "gcs", "<", 15, 1),
]
PARTS = ["resp", "cardio", "hepatic", "coag", "renal", "neuro"]


def _rows(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{float(v)!r}::DOUBLE" if i > 1 else str(v)
                                     for i, v in enumerate(r)) + ")" for r in rows)


def _scores(wide: str, key: str) -> str:
    """``points``: key and a column per part, from a table of one column per signal."""
    signals = list(dict.fromkeys(b[1] for b in SCORE_BANDS))
    oxygen = "nullif(fio2 / CASE WHEN fio2 > 1 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END, 0)"
    return f"""
oxygenated AS (SELECT *, coalesce(pao2 / {oxygen}, CASE WHEN pao2 IS NULL AND spo2 <= 97 THEN (spo2 / {oxygen} - 64.0::DOUBLE) / 0.84::DOUBLE END) AS pf FROM {wide}),
long_signals AS (UNPIVOT (SELECT {key}, {", ".join(f"{x}::DOUBLE AS {x}" for x in signals)} FROM oxygenated)
                 ON {", ".join(signals)} INTO NAME signal VALUE x),
bands(part, signal, side, edge, points) AS (VALUES {_rows(SCORE_BANDS)}),
met AS (SELECT {key}, part, max(points)::INT AS points FROM long_signals JOIN bands USING (signal)
        WHERE (side = '<' AND x < edge) OR (side = '<=' AND x <= edge) OR (side = '>' AND x > edge) OR (side = '>=' AND x >= edge) GROUP BY ALL),
points AS (SELECT o.{key}, {", ".join(f"coalesce(max(points) FILTER (part = '{q}'), 0) AS {q}" for q in PARTS)}
           FROM oxygenated o LEFT JOIN met m ON m.{key} = o.{key} GROUP BY o.{key})"""


SEVERITY_SQL = f"""
sources(signal, item, low, high) AS (VALUES {_rows(SIGNAL_ITEMS)}),
seen AS (
  SELECT c.stay_id, itemid, valuenum AS v FROM cohort c JOIN chartevents e ON e.stay_id = c.stay_id WHERE {WINDOW} AND valuenum IS NOT NULL
  UNION ALL SELECT c.stay_id, itemid, valuenum FROM cohort c JOIN labevents e ON e.hadm_id = c.hadm_id WHERE {WINDOW} AND valuenum IS NOT NULL
  UNION ALL SELECT c.stay_id, itemid, rate FROM cohort c JOIN inputevents e ON e.stay_id = c.stay_id
    WHERE {WINDOW.replace("charttime", "starttime")} AND (rate IS NOT NULL OR itemid = 222315)),
met_items AS (SELECT stay_id, signal, v FROM seen JOIN sources ON item = itemid WHERE low IS NULL OR v BETWEEN low AND high),
drained AS (SELECT c.stay_id, sum(value) AS urine FROM cohort c JOIN outputevents e ON e.stay_id = c.stay_id WHERE {WINDOW} GROUP BY c.stay_id),
aware AS (SELECT c.stay_id, itemid, charttime, valuenum AS v FROM cohort c JOIN chartevents e ON e.stay_id = c.stay_id
          WHERE {WINDOW} AND itemid IN (220739, 223900, 223901) AND valuenum IS NOT NULL),
beside AS (SELECT b.stay_id, b.charttime, b.v, min(o.v) FILTER (o.itemid = 223900) AS verbal, min(o.v) FILTER (o.itemid = 223901) AS motor
           FROM aware b JOIN aware o ON o.stay_id = b.stay_id AND o.itemid <> 220739 AND abs(epoch_us(o.charttime) - epoch_us(b.charttime)) <= 1800000000
           WHERE b.itemid = 220739 GROUP BY ALL),
coma AS (SELECT stay_id, min(v + verbal + motor) AS gcs FROM beside GROUP BY stay_id),
signals AS (
  SELECT c.stay_id, min(v) FILTER (signal = 'pao2') AS pao2, min(v) FILTER (signal = 'spo2') AS spo2, max(v) FILTER (signal = 'fio2') AS fio2,
         avg(v) FILTER (signal = 'map') AS map, max(v) FILTER (signal = 'nore') AS nore, max(v) FILTER (signal = 'epi') AS epi,
         max(v) FILTER (signal = 'dopa') AS dopa, nullif(count(*) FILTER (signal = 'vaso'), 0) AS vaso, max(v) FILTER (signal = 'bili') AS bili,
         min(v) FILTER (signal = 'plate') AS plate, max(v) FILTER (signal = 'creat') AS creat, any_value(urine) AS urine, any_value(gcs) AS gcs
  FROM cohort c LEFT JOIN met_items m ON m.stay_id = c.stay_id LEFT JOIN drained d ON d.stay_id = c.stay_id
  LEFT JOIN coma g ON g.stay_id = c.stay_id GROUP BY c.stay_id),
{_scores("signals", "stay_id")},
severity AS (SELECT p.stay_id, {", ".join(f"{q} AS sofa_{q}" for q in PARTS)}, {" + ".join(PARTS)} AS sofa_total,
  round(urine, 6) AS urine_24h, round(bili, 6) AS bilirubin_max FROM points p JOIN signals s ON s.stay_id = p.stay_id)"""


@REGISTER("severity_score", clinical("SELECT * FROM severity", SEVERITY_SQL))
def severity_score(spark, sf):
    cohort, views = stored_cohort(spark, sf)
    return round_doubles(cl.severity_score(cohort, views["chartevents"], views["labevents"], views["inputevents"],
                                           views["outputevents"]))


@REGISTER("score_bands", """
WITH s AS (
  SELECT l_orderkey, min(CASE WHEN l_returnflag = 'A' THEN l_quantity * 8 END) AS pao2, min(l_quantity + 50) AS spo2,
         max(CASE WHEN l_linenumber <= 3 THEN l_discount * l_linenumber * 100 END) AS fio2,
         max(CASE WHEN l_returnflag = 'N' THEN l_quantity / 3.0::DOUBLE END) AS dopa, max(CASE WHEN l_returnflag = 'R' THEN l_tax * 2 END) AS epi,
         max(CASE WHEN l_linenumber = 5 THEN l_discount END) AS nore, max(CASE WHEN l_linenumber = 6 THEN 1 END) AS vaso,
         avg(l_quantity + 50) AS map, max(l_tax * 200) AS bili, min(l_quantity * 6) AS plate, max(l_tax * 75) AS creat,
         sum(l_quantity * 5) AS urine, min(CASE WHEN l_linenumber > 1 THEN l_quantity / 3.0::DOUBLE END) AS gcs
  FROM lineitem GROUP BY l_orderkey),
{scores}
SELECT p.l_orderkey, round(pf, 6) AS pf, {parts} FROM points p JOIN oxygenated o ON o.l_orderkey = p.l_orderkey""".format(
    scores=_scores("s", "l_orderkey"), parts=", ".join(PARTS)))
def score_bands(spark, sf):
    """Every band over one conditional aggregation per order."""
    c = F.col
    only = lambda cond, v: F.when(cond, v)
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min(only(c("l_returnflag") == "A", c("l_quantity") * 8)).alias("pao2"), F.min(c("l_quantity") + 50).alias("spo2"),
        F.max(only(c("l_linenumber") <= 3, c("l_discount") * c("l_linenumber") * 100)).alias("fio2"),
        F.max(only(c("l_returnflag") == "N", c("l_quantity") / 3.0)).alias("dopa"),
        F.max(only(c("l_returnflag") == "R", c("l_tax") * 2)).alias("epi"),
        F.max(only(c("l_linenumber") == 5, c("l_discount"))).alias("nore"),
        F.max(only(c("l_linenumber") == 6, F.lit(1))).alias("vaso"), F.avg(c("l_quantity") + 50).alias("map"),
        F.max(c("l_tax") * 200).alias("bili"), F.min(c("l_quantity") * 6).alias("plate"),
        F.max(c("l_tax") * 75).alias("creat"), F.sum(c("l_quantity") * 5).alias("urine"),
        F.min(only(c("l_linenumber") > 1, c("l_quantity") / 3.0)).alias("gcs"))
    return s.select(
        "l_orderkey", r6(S.oxygen_ratio(c("pao2"), c("spo2"), c("fio2")), "pf"),
        S.respiratory(c("pao2"), c("spo2"), c("fio2")).alias("resp"),
        S.cardiovascular(c("dopa"), c("epi"), c("nore"), c("vaso"), c("map")).alias("cardio"),
        S.hepatic(c("bili")).alias("hepatic"), S.coagulation(c("plate")).alias("coag"),
        S.renal(c("creat"), c("urine")).alias("renal"), S.neurological(c("gcs")).alias("neuro"))


FEATURES_SQL = f"{ADMIN_SQL}, {VITALS_SQL}, {LABS_SQL}"
_FEATURES_SELECT = f"""
SELECT c.stay_id, c.subject_id, c.hadm_id, round(los_days, 6) AS los_days, round(los_hours, 6) AS los_hours, c.first_careunit,
       epoch_us(intime) AS in_us, c.age::DOUBLE AS age, CASE WHEN upper(gender) = 'M' THEN 1 ELSE 0 END AS gender_male,
       a.* EXCLUDE (stay_id), {", ".join(f"round({n}, 6) AS {n}" for n in [*I.VITAL_COLUMNS, *I.LAB_COLUMNS])},
       round(ln(1 + los_days), 6) AS los_log, CASE WHEN los_days <= 2 THEN 0 WHEN los_days > 7 THEN 2 ELSE 1 END AS los_class
       {{more}}
FROM cohort c LEFT JOIN administrative a ON a.stay_id = c.stay_id LEFT JOIN vital_means v ON v.stay_id = c.stay_id
LEFT JOIN lab_means l ON l.stay_id = c.stay_id {{join}}"""


@REGISTER("base_feature_table", clinical(_FEATURES_SELECT.format(more="", join=""), FEATURES_SQL))
def base_feature_table(spark, sf):
    cohort, views = stored_cohort(spark, sf)
    base = cl.base_features(views, cohort=cohort)
    return round_doubles(base.withColumn("in_us", V.micros("intime")).drop("intime", "outtime"))


@REGISTER("extended_feature_table", clinical(_FEATURES_SELECT.format(
    more=", s.* EXCLUDE (stay_id)", join="LEFT JOIN severity s ON s.stay_id = c.stay_id"), f"{FEATURES_SQL}, {SEVERITY_SQL}"))
def extended_feature_table(spark, sf):
    cohort, views = stored_cohort(spark, sf)
    store = cl.event_store(cohort, views)
    wide = cl.extended_features(cl.base_features(views, cohort=cohort, store=store), cl.severity_from(cohort, store))
    return round_doubles(wide.withColumn("in_us", V.micros("intime")).drop("intime", "outtime"))
