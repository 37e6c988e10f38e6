"""FN-*: scalar functions over names, orders, lines and events."""

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.plans.bindings import LINES, PEOPLE, lines, people, r6, table
from riskloom.registry import query

_DROP = "'m', 'mr', 'mrs', 'ms', 'mme', 'mlle', 'mle', 'dr', 'prof', 'monsieur', 'madame'"
_JOINED = "'m', 'mr', 'mrs', 'ms', 'mme', 'mlle', 'dr', 'prof', 'monsieur', 'madame', 'doctor', 'docteur', 'docteure', 'professeur'"
_TOKENS, _JOINED_TOKENS = (f"list_filter(string_split_regex(lower(strip_accents(x)), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({drop}))" for drop in (_DROP, _JOINED))


@query("fn01_canonical_ids", f"""WITH {PEOPLE}, v AS (SELECT id, concat('Mme  Élodie Šimek Docteur mle Monsieur ', name, '-', segment, ' é pr') AS x FROM people)
SELECT id, array_to_string({_JOINED_TOKENS}, '') AS joined, array_to_string({_TOKENS}, '_') AS spaced,
  regexp_replace(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS header FROM v""")
def fn01(spark, d):
    x = F.concat(F.lit("Mme  Élodie Šimek Docteur mle Monsieur "), "name", F.lit("-"), "segment", F.lit(" é pr"))
    return people(spark, d).select("id", S.canonical_id(x).alias("joined"), S.canonical_id(x, "_").alias("spaced"), S.canonical_name(x).alias("header"))


@query("fn02_safe_double", """WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN replace(CAST(value AS VARCHAR), '.', ',') WHEN 1 THEN concat(' ', CAST(value AS VARCHAR), ' ')
  WHEN 2 THEN 'nan' WHEN 3 THEN '' ELSE event_type END AS x FROM events),
n AS (SELECT event_id, try_cast(replace(trim(x), ',', '.') AS DOUBLE) AS y FROM v)
SELECT event_id, CASE WHEN isnan(y) THEN NULL ELSE y END AS y FROM n""")
def fn02(spark, d):
    text, m = F.col("value").cast("string"), F.col("event_id") % 5
    x = F.when(m == 0, F.replace(text, F.lit("."), F.lit(","))).when(m == 1, F.concat(F.lit(" "), text, F.lit(" "))).when(m == 2, "nan").when(m == 3, "").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", S.safe_double(x).alias("y"))


@query("fn03_05_indicators", """WITH v AS (SELECT o_orderkey, o_orderkey % 6 AS m FROM orders),
t AS (SELECT o_orderkey, CASE m WHEN 0 THEN 'Homme' WHEN 1 THEN ' F ' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'x' ELSE NULL END AS s,
  CASE m WHEN 0 THEN 'Oui' WHEN 1 THEN 'NON' WHEN 2 THEN '2.5' WHEN 3 THEN '-1' WHEN 4 THEN 'x' ELSE NULL END AS y,
  CASE m WHEN 0 THEN 'Mou' WHEN 1 THEN 'dur' WHEN 2 THEN ' soft' WHEN 3 THEN 'Ferme' WHEN 4 THEN 'x' ELSE NULL END AS x FROM v)
SELECT o_orderkey, CASE s WHEN 'Homme' THEN 1 WHEN ' F ' THEN 0 WHEN '1' THEN 1 WHEN '0' THEN 0 END AS male,
  CASE y WHEN 'Oui' THEN 1 WHEN 'NON' THEN 0 WHEN '2.5' THEN 1 WHEN '-1' THEN 0 END AS flag,
  CASE WHEN lower(trim(x)) IN ('mou', 'soft') THEN 1 WHEN lower(trim(x)) IN ('dur', 'ferme') THEN 0 END AS soft FROM t""")
def fn03(spark, d):
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v], F.lit(None).cast("string")), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", S.male_indicator(pick("Homme", " F ", "1", "0", "x")).alias("male"), S.yes_no(pick("Oui", "NON", "2.5", "-1", "x")).alias("flag"),
        S.texture_indicator(pick("Mou", "dur", " soft", "Ferme", "x")).alias("soft"),
    )


@query("fn06_grade_to_event", f"WITH {LINES} SELECT id, CAST(grade IN ('R', 'A') AS INT) AS event FROM lines")
def fn06(spark, d):
    return lines(spark, d).select("id", S.grade_to_event("grade", ("R", "A")).alias("event"))


@query("fn07_sites", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'head' WHEN o_orderpriority LIKE '1%' THEN 'neck' WHEN o_totalprice > 200000 THEN 'body' ELSE 'tail' END AS site,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderpriority ILIKE '%urgent%' OR o_orderpriority ILIKE '%high%' AS INT) ELSE CAST(o_orderstatus = 'F' AS INT) END AS INT) AS any_flag FROM orders""")
def fn07(spark, d):
    status, priority = (F.col("o_orderstatus") == "F").cast("int"), F.col("o_orderpriority")
    flags = [("head", status), ("neck", priority.startswith("1").cast("int")), ("body", (F.col("o_totalprice") > 200000).cast("int"))]
    return table(spark, d, "orders").select(
        "o_orderkey", S.first_flag_site(flags, "tail").alias("site"),
        S.any_flag([F.when(F.col("o_orderkey") % 3 != 0, status)], priority, ("urgent", "high")).alias("any_flag"),
    )


@query("fn08_09_cube_logit", f"""WITH {LINES} SELECT id, round(power(greatest(qty - 20.0, 0), 3), 6) AS cube,
  round(ln(least(greatest(p, 1e-12), 1 - 1e-12) / (1 - least(greatest(p, 1e-12), 1 - 1e-12))), 6) AS logit, round(1 / (1 + exp(-(qty - 25) / 10)), 6) AS prob FROM lines""")
def fn08(spark, d):
    return lines(spark, d).select("id", r6(S.truncated_cube("qty", 20.0), "cube"), r6(S.logit("p"), "logit"), r6(S.sigmoid((F.col("qty") - 25) / 10), "prob"))


#: Published equations: intercepts, weights per unit and spline knots are fixed values.
PREOP = S.LogitSpec("preop", -4.211, {"mpd": 0.388, "neck": 0.131})


@query("fn10_linear_logit", f"""WITH {LINES}, v AS (SELECT id, CASE WHEN qty > 48 THEN NULL ELSE qty / 10 END AS mpd, disc * 100 AS neck FROM lines)
SELECT id, round(1 / (1 + exp(-(-4.211 + 0.388 * mpd + 0.131 * neck))), 6) AS risk FROM v""")
def fn10(spark, d):
    v = lines(spark, d).select("id", F.when(F.col("qty") <= 48, F.col("qty") / 10).alias("mpd"), (F.col("disc") * 100).alias("neck"))
    return v.select("id", r6(S.linear_logit_score(PREOP), "risk"))


@query("fn11_12_points", f"""WITH {LINES}, v AS (SELECT id, CAST(CASE WHEN qty >= 25 THEN 1 ELSE 0 END + CASE WHEN grade = 'R' THEN 2 ELSE 0 END + CASE WHEN disc <= 0.03 THEN 2 ELSE 0 END + CASE WHEN price > 24000 THEN 1 ELSE 0 END AS INT) AS points FROM lines)
SELECT id, points, CASE WHEN points > -1 AND points <= 1 THEN 'low' WHEN points > 1 AND points <= 3 THEN 'intermediate' WHEN points > 3 AND points <= 6 THEN 'high' END AS risk FROM v""")
def fn11(spark, d):
    rules = [(F.col("qty") >= 25, 1), (F.col("grade") == "R", 2), (F.col("disc") <= 0.03, 2), (F.col("price") > 24000, 1)]
    v = lines(spark, d).select("id", S.point_score(rules).alias("points"))
    return v.select("id", "points", S.cut("points", [-1, 1, 3, 6], ["low", "intermediate", "high"]).alias("risk"))


@query("fn13_risk_group", f"""WITH {LINES} SELECT id, CASE WHEN q < 0.3 THEN 'low' WHEN q < 0.7 THEN 'intermediate' ELSE 'high' END AS left_closed,
  CASE WHEN q <= 0.3 THEN 'low' WHEN q <= 0.7 THEN 'intermediate' ELSE 'high' END AS right_closed FROM lines""")
def fn13(spark, d):
    return lines(spark, d).select("id", S.risk_group("q", 0.3, 0.7).alias("left_closed"), S.risk_group("q", 0.3, 0.7, "right").alias("right_closed"))


@query("fn14_15_batches", f"""WITH {PEOPLE} SELECT id, CASE WHEN lower(segment) LIKE '%auto%' AND lower(nation) LIKE '%1%' THEN 'A1' WHEN lower(segment) LIKE '%house%' THEN 'H' ELSE 'Other' END AS grp,
  concat(segment, '_', nation) AS batch FROM people""")
def fn14(spark, d):
    rules = [("auto", "1", "A1"), ("house", "", "H")]
    return people(spark, d).select("id", S.batch_group("segment", "nation", rules).alias("grp"), S.concat_batch_id("segment", "nation").alias("batch"))


@query("fn16_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def fn16(spark, d):
    m, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(m == 0, F.date_format(day, "yyyyMMdd")).when(m == 1, F.date_format(day, "yyyy-MM-dd")).when(m == 2, F.date_format(day, "dd/MM/yyyy")).otherwise("notadate")
    return table(spark, d, "orders").select("o_orderkey", S.parse_date_multi(text).alias("day"))


@query("fn17_families", """WITH v AS (SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN 'log-sigma-3-0-mm-3D_' WHEN 1 THEN 'wavelet-HLH_' ELSE 'original_' END, CASE page_id % 4 WHEN 0 THEN 'glcm' WHEN 1 THEN 'firstorder' WHEN 2 THEN 'shape' ELSE 'misc' END, '_', url) AS n FROM pages)
SELECT page_id, CASE WHEN n LIKE 'log%' THEN 'log' WHEN n LIKE 'wavelet%' THEN 'wavelet' ELSE 'original' END AS image, CASE page_id % 4 WHEN 0 THEN 'glcm' WHEN 1 THEN 'firstorder' WHEN 2 THEN 'shape' ELSE 'other' END AS kind FROM v""")
def fn17(spark, d):
    image = F.when(F.col("page_id") % 3 == 0, "log-sigma-3-0-mm-3D_").when(F.col("page_id") % 3 == 1, "wavelet-HLH_").otherwise("original_")
    kind = F.when(F.col("page_id") % 4 == 0, "glcm").when(F.col("page_id") % 4 == 1, "firstorder").when(F.col("page_id") % 4 == 2, "shape").otherwise("misc")
    a, b = S.feature_family(F.concat(image, kind, F.lit("_"), "url"))
    return table(spark, d, "pages").select("page_id", a.alias("image"), b.alias("kind"))


@query("fn19_safe_ids", f"""WITH {PEOPLE}, v AS (SELECT id, CASE WHEN id % 10 = 0 THEN ' # ' ELSE concat(name, ' / ', segment) END AS x FROM people)
SELECT id, coalesce(nullif(regexp_replace(regexp_replace(trim(x), '[^A-Za-z0-9._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), ''), 'unknown') AS safe,
  regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM v""")
def fn19(spark, d):
    x = F.when(F.col("id") % 10 == 0, " # ").otherwise(F.concat("name", F.lit(" / "), "segment"))
    return people(spark, d).select("id", S.safe_id(x).alias("safe"), S.slug(x).alias("slug"))


@query("fn20_fingerprint", """SELECT event_id, md5(concat('{"event_type":"', event_type, '","user_id":', user_id, '}')) AS print FROM events""")
def fn20(spark, d):
    return table(spark, d, "events").select("event_id", S.fingerprint(["user_id", "event_type"], "md5").alias("print"))


@query("fn21_22_units_fields", """SELECT event_id, round(value * 0.5, 6) AS half, json_extract_string(props, '$.k') AS field FROM events""")
def fn21(spark, d):
    return table(spark, d, "events").select("event_id", r6(S.unit_convert("value", 0.5), "half"), S.coalesce_fields("props", ["missing", "k"]).alias("field"))


@query("ud05_sql_functions", f"WITH {LINES} SELECT id, round(power(greatest(qty - 10.0, 0), 3), 6) AS cube, round(ln(p / (1 - p)), 6) AS logit FROM lines")
def ud05(spark, d):
    S.register_sql_functions(spark)
    return lines(spark, d).select("id", r6(F.expr("truncated_cube(qty, 10D)"), "cube"), r6(F.expr("safe_logit(p)"), "logit"))
