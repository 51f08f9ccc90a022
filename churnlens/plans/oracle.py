"""Independent DuckDB statements of each SQL-checkable query.

Each entry is plain SQL over the driver's tables.  Shared parts (the subscriber view,
the cleaned view, the rule-scored view) are CTE text blocks composed here.
DuckDB's ``printf`` rounds exactly like Python (binary value, ties to even), so
``CAST(printf('%.4f', x) AS DOUBLE)`` states Python's ``round(x, 4)``.
"""

from __future__ import annotations

from churnlens.functions.columns import NUMBER_PATTERN
from churnlens.functions.rounding import sql_round

R = sql_round


def _days(a: str, b: str) -> str:
    return f"date_diff('day', {a}, {b})"


SUBSCRIBERS_RAW = f"""
o_hist AS (
  SELECT o_custkey AS k,
         MIN(CAST(o_orderdate AS DATE)) AS first_order,
         MAX(CAST(o_orderdate AS DATE)) AS last_order,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS tot,
         COUNT(*) AS n_orders,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent
  FROM orders GROUP BY o_custkey),
o_latest AS (SELECT MAX(last_order) AS mx FROM o_hist),
subscribers_raw AS (
  SELECT c_custkey AS cust_key,
         c_name AS customer_id,
         CAST(CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS senior_citizen,
         CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS partner,
         CASE WHEN c_nationkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS dependents,
         CASE WHEN urgent > 0 THEN 'Yes' ELSE 'No' END AS paperless_billing,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'Month-to-month'
              WHEN c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN 'One year' ELSE 'Two year' END AS contract,
         CASE WHEN c_nationkey < 8 THEN 'DSL' WHEN c_nationkey < 17 THEN 'Fiber optic' ELSE 'No' END AS internet_service,
         CASE c_nationkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
              WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS payment_method,
         CAST(CASE WHEN c_custkey % 3 = 0 THEN FLOOR({_days('first_order', 'last_order')} / 30.0)
                   WHEN c_custkey % 3 = 1 THEN FLOOR({_days('first_order', 'last_order')} / 60.0)
                   ELSE FLOOR({_days('first_order', 'last_order')} / 240.0) END AS INTEGER) AS tenure,
         {R('CAST(tot AS DOUBLE) / n_orders / CAST(1000 AS DOUBLE)', 2)} AS monthly_charges,
         CASE WHEN c_acctbal < 0 THEN ' ' ELSE CAST(CAST(ROUND(tot, 0) AS BIGINT) AS VARCHAR) END AS total_charges,
         CASE WHEN {_days('last_order', '(SELECT mx FROM o_latest)')} > 180 THEN 'Yes' ELSE 'No' END AS churn
  FROM customer JOIN o_hist ON k = c_custkey)"""

PARSED = f"""CASE WHEN regexp_full_match(trim(total_charges), '{NUMBER_PATTERN}')
              THEN TRY_CAST(trim(total_charges) AS DOUBLE) END"""

SUBSCRIBERS = f"""{SUBSCRIBERS_RAW},
subscribers AS (
  SELECT cust_key, customer_id, senior_citizen, partner, dependents, paperless_billing, contract,
         internet_service, payment_method, tenure, monthly_charges,
         {PARSED} AS total_charges,
         CASE WHEN lower(trim(churn)) IN ('yes', '1') THEN 1 WHEN lower(trim(churn)) IN ('no', '0') THEN 0 END AS churn
  FROM subscribers_raw
  WHERE {PARSED} IS NOT NULL)"""


def with_subscribers(body: str) -> str:
    return f"WITH {SUBSCRIBERS}\n{body}"


ORACLE: dict[str, str] = {}

ORACLE["S1_subscriber_table"] = f"WITH {SUBSCRIBERS_RAW}\nSELECT * FROM subscribers_raw"

ORACLE["V1_parse_numeric"] = f"""WITH {SUBSCRIBERS_RAW}
SELECT cust_key, total_charges AS total_charges_text, {PARSED} AS total_charges FROM subscribers_raw"""

ORACLE["V2_drop_unparsable"] = with_subscribers("SELECT * FROM subscribers")

ORACLE["V2_dropped_count"] = f"""WITH {SUBSCRIBERS_RAW}
SELECT CAST(COUNT(*) AS BIGINT) AS n_before,
       CAST(SUM(CASE WHEN {PARSED} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dropped
FROM subscribers_raw"""

ORACLE["V5_encode_label"] = with_subscribers("SELECT cust_key, churn FROM subscribers")

ORACLE["V9_null_profile"] = f"""WITH {SUBSCRIBERS_RAW},
parsed AS (SELECT *, {PARSED} AS total_num FROM subscribers_raw),
counts AS (
  SELECT 'senior_citizen' AS "column", CAST(SUM(CASE WHEN senior_citizen IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count FROM parsed
  UNION ALL SELECT 'partner', CAST(SUM(CASE WHEN partner IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM parsed
  UNION ALL SELECT 'dependents', CAST(SUM(CASE WHEN dependents IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM parsed
  UNION ALL SELECT 'paperless_billing', CAST(SUM(CASE WHEN paperless_billing IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM parsed
  UNION ALL SELECT 'contract', CAST(SUM(CASE WHEN contract IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM parsed
  UNION ALL SELECT 'internet_service', CAST(SUM(CASE WHEN internet_service IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM parsed
  UNION ALL SELECT 'payment_method', CAST(SUM(CASE WHEN payment_method IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM parsed
  UNION ALL SELECT 'tenure', CAST(SUM(CASE WHEN tenure IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM parsed
  UNION ALL SELECT 'monthly_charges', CAST(SUM(CASE WHEN monthly_charges IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM parsed
  UNION ALL SELECT 'total_charges', CAST(SUM(CASE WHEN total_num IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM parsed)
SELECT * FROM counts WHERE null_count > 0"""

ORACLE["V10_dataset_summary"] = with_subscribers("""
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, 13 AS n_columns,
       CAST(COALESCE(SUM(churn), 0) AS BIGINT) AS churn_count,
       CASE WHEN COUNT(*) = 0 THEN 0.0 ELSE CAST(COALESCE(SUM(churn), 0) AS DOUBLE) / COUNT(*) END AS churn_rate
FROM subscribers""")

ORACLE["Q2_churn_distribution"] = with_subscribers("""
SELECT 'No Churn' AS label, CAST(SUM(CASE WHEN churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS value, 0 AS position FROM subscribers
UNION ALL
SELECT 'Churn', CAST(SUM(CASE WHEN churn = 1 THEN 1 ELSE 0 END) AS BIGINT), 1 FROM subscribers""")

ORACLE["Q3_churn_by_contract"] = with_subscribers(f"""
SELECT contract, {R('AVG(churn)', 4)} AS churn_rate, CAST(COUNT(*) AS BIGINT) AS count
FROM subscribers WHERE contract IS NOT NULL GROUP BY contract ORDER BY contract""")

ORACLE["Q4_churn_by_contract_ranked"] = with_subscribers(f"""
SELECT contract, {R('AVG(churn)', 4)} AS churn_rate, CAST(COUNT(*) AS BIGINT) AS count
FROM subscribers WHERE contract IS NOT NULL GROUP BY contract ORDER BY AVG(churn) DESC, contract""")

TENURE_INDEX = """CASE WHEN tenure >= 0 AND tenure <= 12 THEN 0 WHEN tenure > 12 AND tenure <= 24 THEN 1
                       WHEN tenure > 24 AND tenure <= 48 THEN 2 WHEN tenure > 48 AND tenure <= 72 THEN 3 END"""

ORACLE["Q5_tenure_band"] = with_subscribers(f"""
SELECT cust_key, tenure,
       ['0-12', '13-24', '25-48', '49-72'][{TENURE_INDEX} + 1] AS tenure_bin
FROM subscribers""")

ORACLE["Q6_churn_by_tenure"] = with_subscribers(f"""
SELECT ['0-12', '13-24', '25-48', '49-72'][b + 1] AS tenure_bin, {R('AVG(churn)', 4)} AS churn_rate,
       CAST(COUNT(*) AS BIGINT) AS count, b AS tenure_bin_index
FROM (SELECT {TENURE_INDEX} AS b, churn FROM subscribers) t
WHERE b IS NOT NULL GROUP BY b ORDER BY b""")


# --- given clusters, profiles, rule-scored views -----------------------------
def _mode(col: str, out: str) -> str:
    return f"""{out}_m AS (
  SELECT cluster_id, {col} AS {out} FROM (
    SELECT cluster_id, {col}, row_number() OVER (PARTITION BY cluster_id ORDER BY COUNT(*) DESC, {col}) AS rn
    FROM clustered WHERE {col} IS NOT NULL GROUP BY cluster_id, {col}) WHERE rn = 1)"""


def _share(col: str) -> str:
    return f"AVG(CASE WHEN {col} = 'Yes' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


PROFILES = f"""{SUBSCRIBERS},
clustered AS (SELECT *, CAST(cust_key % 4 AS INTEGER) AS cluster_id FROM subscribers),
stats AS (
  SELECT cluster_id, CAST(COUNT(*) AS BIGINT) AS count,
         AVG(tenure) AS avg_tenure, AVG(monthly_charges) AS avg_monthly_charges,
         AVG(total_charges) AS avg_total_charges, AVG(CAST(churn AS DOUBLE)) AS churn_rate,
         AVG(CAST(senior_citizen AS DOUBLE)) AS pct_senior, {_share('partner')} AS pct_partner,
         {_share('dependents')} AS pct_dependents, {_share('paperless_billing')} AS pct_paperless
  FROM clustered GROUP BY cluster_id),
g AS (SELECT AVG(tenure) AS g_tenure, AVG(monthly_charges) AS g_monthly FROM clustered),
{_mode('contract', 'top_contract')},
{_mode('internet_service', 'top_internet')},
{_mode('payment_method', 'top_payment')},
named AS (
  SELECT s.*, CAST(s.count AS DOUBLE) / SUM(s.count) OVER () AS pct_of_customers,
         c.top_contract, i.top_internet, p.top_payment,
         printf('Avg tenure %.1f months', s.avg_tenure) || ' | ' ||
         printf('Avg monthly charges $%.2f', s.avg_monthly_charges) || ' | ' ||
         'Most common contract: ' || c.top_contract || ' | ' ||
         'Most common internet: ' || i.top_internet || ' | ' ||
         printf('Churn rate %.1f%%', 100 * s.churn_rate) || ' | ' ||
         printf('Senior citizens %.1f%%', 100 * s.pct_senior) || ' | ' ||
         printf('Have partner %.1f%%', 100 * s.pct_partner) AS characteristics,
         (CASE WHEN s.avg_tenure < g.g_tenure * 0.7 THEN 'New' WHEN s.avg_tenure > g.g_tenure * 1.3 THEN 'Loyal' ELSE 'Steady' END)
         || ' ' ||
         (CASE WHEN s.avg_monthly_charges > g.g_monthly * 1.15 THEN 'High-Spend'
               WHEN s.avg_monthly_charges < g.g_monthly * 0.85 THEN 'Value' ELSE 'Mid-Spend' END)
         || ' ' ||
         (CASE WHEN s.churn_rate >= 0.40 THEN 'High-Risk' WHEN s.churn_rate <= 0.15 THEN 'Low-Risk' ELSE 'Moderate-Risk' END)
         || ' Customers' AS base_name
  FROM stats s CROSS JOIN g
  LEFT JOIN top_contract_m c USING (cluster_id) LEFT JOIN top_internet_m i USING (cluster_id)
  LEFT JOIN top_payment_m p USING (cluster_id)),
profiles AS (
  SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY base_name) > 1
                 THEN base_name || ' (C' || CAST(cluster_id AS VARCHAR) || ')' ELSE base_name END AS persona_name
  FROM named)"""


def with_profiles(body: str) -> str:
    return f"WITH {PROFILES}\n{body}"


PROFILE_COLS = f"""cluster_id, count, {R('pct_of_customers', 6)} AS pct_of_customers, {R('avg_tenure', 6)} AS avg_tenure,
       {R('avg_monthly_charges', 6)} AS avg_monthly_charges, {R('avg_total_charges', 6)} AS avg_total_charges,
       {R('churn_rate', 6)} AS churn_rate, {R('pct_senior', 6)} AS pct_senior, {R('pct_partner', 6)} AS pct_partner,
       {R('pct_dependents', 6)} AS pct_dependents, top_contract, top_internet, top_payment,
       {R('pct_paperless', 6)} AS pct_paperless, characteristics, persona_name"""

ORACLE["C1_cluster_profiles"] = with_profiles(f"SELECT {PROFILE_COLS} FROM profiles ORDER BY cluster_id")
ORACLE["C2_characteristics"] = with_profiles("SELECT cluster_id, characteristics FROM profiles")
ORACLE["C3_persona_name"] = with_profiles("SELECT cluster_id, persona_name FROM profiles")
ORACLE["C5_persona_lookup"] = with_profiles(f"""
SELECT cluster_id, persona_name, characteristics, count, {R('churn_rate', 6)} AS churn_rate,
       {R('avg_tenure', 6)} AS avg_tenure, {R('avg_monthly_charges', 6)} AS avg_monthly_charges FROM profiles""")
ORACLE["C6_split_characteristics"] = with_profiles("""
SELECT cluster_id, CAST(pos - 1 AS INTEGER) AS position, statement
FROM (SELECT cluster_id, unnest(string_split(characteristics, ' | ')) AS statement,
             unnest(range(1, len(string_split(characteristics, ' | ')) + 1)) AS pos
      FROM profiles WHERE characteristics <> '')""")


def _js_round1(x: str) -> str:
    """JavaScript toFixed(1) then Number: nearest tenth, exact ties away from zero."""
    return f"""(CASE WHEN CAST(printf('%.1f', {x}) AS DOUBLE) < {x} AND {x} - CAST(printf('%.1f', {x}) AS DOUBLE) = 0.05
                  THEN CAST(printf('%.1f', {x}) AS DOUBLE) + 0.1 ELSE CAST(printf('%.1f', {x}) AS DOUBLE) END)"""


ORACLE["C7_persona_display"] = with_profiles(f"""
SELECT cluster_id, persona_name, {_js_round1('churn_rate * 100')} AS churn_pct,
       {_js_round1('pct_of_customers * 100')} AS share_pct, churn_rate >= 0.3 AS high_churn FROM profiles""")

RULE_SCORED = f"""{SUBSCRIBERS},
scored AS (
  SELECT *, CAST(12 AS DOUBLE) / (CAST(12 AS DOUBLE) + tenure) AS score,
         CAST(CAST(12 AS DOUBLE) / (CAST(12 AS DOUBLE) + tenure) > 0.5 AS INTEGER) AS prediction, churn AS label
  FROM subscribers)"""

CM = """SELECT CAST(SUM(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(SUM(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(SUM(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM scored"""


def _d(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END)"


ORACLE["E1_confusion_matrix"] = f"WITH {RULE_SCORED}\n{CM}"
ORACLE["E2_binary_metrics"] = f"""WITH {RULE_SCORED}, cm AS ({CM})
SELECT {_d('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_d('tp', 'tp + fp')} AS precision,
       {_d('tp', 'tp + fn')} AS recall, {_d('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cm"""

SCORE_COUNTS = """counts AS (
  SELECT CAST(score AS DOUBLE) AS threshold, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
         SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg FROM scored GROUP BY score)"""

ORACLE["E3_roc_auc"] = f"""WITH {RULE_SCORED}, {SCORE_COUNTS},
run AS (SELECT *, SUM(neg) OVER (ORDER BY threshold ROWS UNBOUNDED PRECEDING) AS cum_neg FROM counts)
SELECT CASE WHEN SUM(pos) = 0 OR SUM(neg) = 0 THEN NULL
            ELSE CAST(SUM(pos * (cum_neg - neg)) + SUM(pos * neg) * 0.5 AS DOUBLE) / (SUM(pos) * SUM(neg)) END AS roc_auc
FROM run"""

ORACLE["E4_roc_curve"] = f"""WITH {RULE_SCORED}, {SCORE_COUNTS},
run AS (SELECT *, SUM(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
               SUM(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
               LEAD(pos) OVER (ORDER BY threshold DESC) AS next_pos, LEAD(neg) OVER (ORDER BY threshold DESC) AS next_neg,
               row_number() OVER (ORDER BY threshold DESC) AS i FROM counts),
tot AS (SELECT SUM(pos) AS p, SUM(neg) AS n FROM counts)
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT threshold, {_d('cum_neg', 'n')}, {_d('cum_pos', 'p')}
FROM run, tot WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"""

ORACLE["E5_classification_report"] = f"""WITH {RULE_SCORED}, cm AS ({CM}),
per AS (
  SELECT 0 AS position, 'No Churn' AS label, {_d('tn', 'tn + fn')} AS precision, {_d('tn', 'tn + fp')} AS recall,
         {_d('2 * tn', '2 * tn + fn + fp')} AS f1, tn + fp AS support, tn + fp + fn + tp AS n FROM cm
  UNION ALL
  SELECT 1, 'Churn', {_d('tp', 'tp + fp')}, {_d('tp', 'tp + fn')}, {_d('2 * tp', '2 * tp + fp + fn')}, tp + fn,
         tn + fp + fn + tp FROM cm)
SELECT position, label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM per
UNION ALL
SELECT 2, 'accuracy', NULL, NULL, {_d('tp + tn', 'tp + tn + fp + fn')}, CAST(tp + tn + fp + fn AS BIGINT) FROM cm
UNION ALL
SELECT 3, 'macro avg', a.precision * 0.5 + b.precision * 0.5, a.recall * 0.5 + b.recall * 0.5, a.f1 * 0.5 + b.f1 * 0.5,
       CAST(a.n AS BIGINT) FROM per a, per b WHERE a.position = 0 AND b.position = 1
UNION ALL
SELECT 4, 'weighted avg', a.precision * {_d('a.support', 'a.n')} + b.precision * {_d('b.support', 'a.n')},
       a.recall * {_d('a.support', 'a.n')} + b.recall * {_d('b.support', 'a.n')},
       a.f1 * {_d('a.support', 'a.n')} + b.f1 * {_d('b.support', 'a.n')}, CAST(a.n AS BIGINT)
FROM per a, per b WHERE a.position = 0 AND b.position = 1"""

DASHBOARD_SCORED = f"""{PROFILES},
dash AS (
  SELECT c.customer_id, c.tenure, c.contract, c.monthly_charges, c.internet_service,
         CASE WHEN c.churn = 1 THEN 'Yes' WHEN c.churn = 0 THEN 'No' END AS churn,
         CASE WHEN c.p >= 0.66 THEN 'High' WHEN c.p >= 0.33 THEN 'Medium' WHEN c.p IS NOT NULL THEN 'Low' END AS risk_level,
         COALESCE(pr.persona_name, 'Cluster ' || CAST(c.cluster_id AS VARCHAR)) AS persona_name,
         c.cluster_id, c.p AS churn_probability
  FROM (SELECT *, CAST(12 AS DOUBLE) / (CAST(12 AS DOUBLE) + tenure) AS p FROM clustered) c
  LEFT JOIN profiles pr USING (cluster_id))"""


def with_dash(body: str) -> str:
    return f"WITH {DASHBOARD_SCORED}\n{body}"


ORACLE["R1_risk_level"] = with_dash("SELECT customer_id, churn_probability, risk_level FROM dash")
ORACLE["R3_label_text"] = with_subscribers(
    "SELECT cust_key, CASE WHEN churn = 1 THEN 'Yes' WHEN churn = 0 THEN 'No' END AS churn FROM subscribers")
ORACLE["R4_attach_persona"] = with_dash("SELECT customer_id, cluster_id, persona_name FROM dash")
ORACLE["Q1_kpi_summary"] = with_dash(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_customers,
       CAST(SUM(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS churned_customers,
       {R(_d("SUM(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END)", 'COUNT(*)'), 6)} AS churn_rate,
       CAST(SUM(CASE WHEN risk_level = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count,
       4 AS persona_count, {R('AVG(tenure)', 6)} AS avg_tenure, {R('AVG(monthly_charges)', 6)} AS avg_monthly_charges
FROM dash""")
ORACLE["Q7_persona_distribution"] = with_profiles(
    f"SELECT persona_name AS persona, count, {R('churn_rate', 4)} AS churn_rate, cluster_id FROM profiles ORDER BY cluster_id")
ORACLE["Q8_percent_of_rate"] = with_subscribers(f"""
SELECT contract, {_js_round1(R('AVG(churn)', 4) + ' * 100')} AS churn_pct,
       {R('CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER ()', 6)} AS share
FROM subscribers WHERE contract IS NOT NULL GROUP BY contract""")
ORACLE["Q9_search_customers"] = with_dash(
    "SELECT customer_id FROM dash WHERE regexp_matches(customer_id, 'CUSTOMER#0000001.5', 'i')")
ORACLE["Q10_filter_contract"] = with_dash("SELECT customer_id, contract FROM dash WHERE contract = 'One year'")
ORACLE["Q11_filter_churn"] = with_dash("SELECT customer_id, churn FROM dash WHERE churn = 'Yes'")
ORACLE["Q12_filter_risk"] = with_dash("SELECT customer_id, risk_level FROM dash WHERE lower(risk_level) = 'high'")
ORACLE["Q13_filter_persona"] = with_dash(
    "SELECT customer_id, persona_name FROM dash WHERE regexp_matches(persona_name, 'steady|loyal', 'i')")
LISTING = """FROM dash WHERE regexp_matches(customer_id, 'customer', 'i') AND contract = 'Month-to-month' AND churn = 'No'"""
ORACLE["Q14_list_customers"] = with_dash(f"""
SELECT customer_id, tenure, contract, monthly_charges, internet_service, churn, risk_level, persona_name, cluster_id,
       churn_probability {LISTING} ORDER BY customer_id LIMIT 20 OFFSET 20""")
ORACLE["Q15_page_count"] = with_dash(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(GREATEST(1, CEIL(COUNT(*) / 20.0)) AS BIGINT) AS page_count {LISTING}""")


# --- features ----------------------------------------------------------------------
CAT_COLS = ["partner", "dependents", "paperless_billing", "contract", "internet_service", "payment_method"]
N_NUMERIC = 4

CATS = "cats AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT cust_key, '{c}' AS col, {i} AS ord, {c} AS val FROM subscribers" for i, c in enumerate(CAT_COLS)) + ")"

SLOTS_BODY = f"""dist AS (SELECT DISTINCT col, ord, val FROM cats WHERE val IS NOT NULL),
ranked AS (SELECT col, ord, val, row_number() OVER (PARTITION BY col ORDER BY val) - 1 AS r,
                  COUNT(*) OVER (PARTITION BY col) AS card FROM dist),
offs AS (SELECT col, COALESCE(SUM(card) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
         FROM (SELECT DISTINCT col, ord, card FROM ranked)),
slot_names AS (SELECT CAST({N_NUMERIC} + o.off + r.r AS INTEGER) AS feature_index, r.col || '_' || r.val AS feature,
                      r.col, r.val FROM ranked r JOIN offs o USING (col))"""
SLOTS = f"{CATS},\n{SLOTS_BODY}"

ORACLE["F1_impute_median"] = f"""WITH {SUBSCRIBERS_RAW},
parsed AS (SELECT cust_key, {PARSED} AS total_num FROM subscribers_raw)
SELECT cust_key, COALESCE(total_num, (SELECT median(total_num) FROM parsed)) AS total_charges FROM parsed"""

ORACLE["F2_impute_most_frequent"] = with_subscribers(f"""{CATS.replace('cats AS (', ', cats AS (', 1)}
SELECT col AS "column", val AS "mode" FROM (
  SELECT col, val, row_number() OVER (PARTITION BY col ORDER BY COUNT(*) DESC, val) AS rn
  FROM cats WHERE val IS NOT NULL GROUP BY col, val) WHERE rn = 1""")

ORACLE["F3_one_hot"] = with_subscribers(f""", {SLOTS}
SELECT c.cust_key, s.feature_index, s.feature FROM cats c JOIN slot_names s ON c.col = s.col AND c.val = s.val""")

ORACLE["F3_category_dictionary"] = ORACLE["F3_one_hot"]

NUMERIC_NAMES = "SELECT 0 AS feature_index, 'senior_citizen' AS feature UNION ALL SELECT 1, 'tenure' UNION ALL SELECT 2, 'monthly_charges' UNION ALL SELECT 3, 'total_charges'"

ORACLE["F4_feature_names"] = with_subscribers(f""", {SLOTS}
{NUMERIC_NAMES} UNION ALL SELECT feature_index, feature FROM slot_names""")

ORACLE["F6_standardize"] = with_subscribers(f""", {SLOTS},
slot_x AS (SELECT s.feature_index, s.feature, CASE WHEN c.val = s.val THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x
           FROM cats c JOIN slot_names s ON c.col = s.col),
num_x AS (SELECT 0 AS feature_index, 'senior_citizen' AS feature, CAST(senior_citizen AS DOUBLE) AS x FROM subscribers
          UNION ALL SELECT 1, 'tenure', CAST(tenure AS DOUBLE) FROM subscribers
          UNION ALL SELECT 2, 'monthly_charges', monthly_charges FROM subscribers
          UNION ALL SELECT 3, 'total_charges', total_charges FROM subscribers)
SELECT feature_index, feature, {R('AVG(x)', 6)} AS mean, {R('STDDEV_POP(x)', 6)} AS std
FROM (SELECT * FROM slot_x UNION ALL SELECT * FROM num_x) GROUP BY feature_index, feature""")

SPLIT = """cls AS (SELECT churn, COUNT(*) AS c FROM subscribers GROUP BY churn),
tot AS (SELECT SUM(c) AS n, CAST(CEIL(CAST(0.2 AS DOUBLE) * SUM(c)) AS BIGINT) AS n_test FROM cls),
cont AS (SELECT churn, c, CAST(c AS DOUBLE) / n * (n - n_test) AS x, n - n_test AS n_train FROM cls, tot),
fl AS (SELECT *, FLOOR(x) AS f, x - FLOOR(x) AS r FROM cont),
need AS (SELECT n_train - SUM(f) AS k FROM fl GROUP BY n_train),
alloc AS (SELECT churn, c - (f + CASE WHEN row_number() OVER (ORDER BY r DESC, churn) <= (SELECT k FROM need)
                                      THEN 1 ELSE 0 END) AS t FROM fl),
split AS (SELECT s.cust_key, s.churn, row_number() OVER (PARTITION BY s.churn ORDER BY md5(s.customer_id || ':42'),
                 s.customer_id) <= a.t AS is_test FROM subscribers s JOIN alloc a USING (churn))"""

ORACLE["F7_stratified_split"] = with_subscribers(f""", {SPLIT}
SELECT cust_key, churn, is_test FROM split""")

ORACLE["F8_class_weights"] = with_subscribers("""
SELECT churn AS label, COUNT(*) AS count,
       CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / (COUNT(*) OVER () * COUNT(*)) AS weight
FROM subscribers GROUP BY churn""")

ORACLE["M2_model_metadata"] = with_subscribers(f""", {SLOTS}, {SPLIT}
SELECT CAST(SUM(CASE WHEN NOT is_test THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(SUM(CASE WHEN is_test THEN 1 ELSE 0 END) AS BIGINT) AS n_test,
       CAST((SELECT COUNT(*) FROM slot_names) + {N_NUMERIC} AS INTEGER) AS n_features, 42 AS random_state,
       CAST(0.2 AS DOUBLE) AS test_size, 8 AS max_depth, 20 AS min_samples_leaf FROM split""")


# --- root Gini scan and drivers ------------------------------------------------------
def _gini(a1: str, a0: str) -> str:
    s = f"({a1} + {a0})"
    return (f"(CASE WHEN {s} > 0 THEN CAST(1 AS DOUBLE) - ({a1} / {s}) * ({a1} / {s}) - ({a0} / {s}) * ({a0} / {s}) "
            f"ELSE CAST(0 AS DOUBLE) END)")


_W1 = "(CASE WHEN t1 > 0 THEN (t1 + t0) / (CAST(2 AS DOUBLE) * t1) ELSE CAST(0 AS DOUBLE) END)"
_W0 = "(CASE WHEN t0 > 0 THEN (t1 + t0) / (CAST(2 AS DOUBLE) * t0) ELSE CAST(0 AS DOUBLE) END)"
_L1, _L0 = f"(c1 * {_W1})", f"(c0 * {_W0})"
_R1, _R0 = f"((t1 - c1) * {_W1})", f"((t0 - c0) * {_W0})"
_P1, _P0 = f"(t1 * {_W1})", f"(t0 * {_W0})"
_TOT = f"({_P1} + {_P0})"
_GAIN = (f"{_gini(_P1, _P0)} - (({_L1} + {_L0}) / {_TOT}) * {_gini(_L1, _L0)} "
         f"- (({_R1} + {_R0}) / {_TOT}) * {_gini(_R1, _R0)}")

GAINS = f"""{CATS},
cnt AS (SELECT col, val, CAST(SUM(CASE WHEN churn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c1,
               CAST(SUM(CASE WHEN churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS c0
        FROM cats c JOIN subscribers s USING (cust_key) GROUP BY col, val),
tots AS (SELECT *, SUM(c1) OVER (PARTITION BY col) AS t1, SUM(c0) OVER (PARTITION BY col) AS t0 FROM cnt),
gains AS (SELECT col || '_' || val AS feature, CASE WHEN {_TOT} > 0 THEN {_GAIN} ELSE CAST(0 AS DOUBLE) END AS gain
          FROM tots WHERE val IS NOT NULL),
imp AS (SELECT feature, CASE WHEN gain > 0 THEN gain / SUM(gain) OVER () ELSE CAST(0 AS DOUBLE) END AS importance FROM gains),
drivers AS (SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp)"""

ORACLE["D4_root_gini_gain"] = with_subscribers(f", {GAINS}\nSELECT feature, {R('gain', 6)} AS gain FROM gains")
ORACLE["D4_numeric_splits"] = with_subscribers(f""",
vals AS (SELECT 'senior_citizen' AS feature, CAST(senior_citizen AS DOUBLE) AS v, churn FROM subscribers
         UNION ALL SELECT 'tenure', CAST(tenure AS DOUBLE), churn FROM subscribers
         UNION ALL SELECT 'monthly_charges', CAST(monthly_charges AS DOUBLE), churn FROM subscribers
         UNION ALL SELECT 'total_charges', CAST(total_charges AS DOUBLE), churn FROM subscribers),
per AS (SELECT feature, v, CAST(SUM(churn) AS BIGINT) AS p, CAST(SUM(1 - churn) AS BIGINT) AS n FROM vals WHERE v IS NOT NULL GROUP BY feature, v),
swept AS (SELECT feature, v, lead(v) OVER w AS next_v, CAST(SUM(p) OVER w AS BIGINT) AS c1, CAST(SUM(n) OVER w AS BIGINT) AS c0,
                 CAST(SUM(p) OVER (PARTITION BY feature) AS BIGINT) AS t1, CAST(SUM(n) OVER (PARTITION BY feature) AS BIGINT) AS t0
          FROM per WINDOW w AS (PARTITION BY feature ORDER BY v)),
rated AS (SELECT feature, (v + next_v) / 2.0 AS threshold, c1 + c0 AS n_left, t1 + t0 - c1 - c0 AS n_right,
                 CASE WHEN {_TOT} > 0 THEN {_GAIN} ELSE CAST(0 AS DOUBLE) END AS gain FROM swept WHERE next_v IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY ROUND(gain, 12) DESC, threshold) AS place FROM rated)
SELECT feature, {R('threshold', 6)} AS threshold, {R('gain', 6)} AS gain, n_left, n_right FROM best WHERE place = 1""")
ORACLE["D2_top_drivers"] = with_subscribers(
    f", {GAINS}\nSELECT feature, {R('importance', 6)} AS importance, rank FROM drivers WHERE rank <= 15")


def _js_round(x: str, d: int) -> str:
    """JavaScript toFixed(d) then Number: nearest, exact ties away from zero."""
    half = 0.5 / 10**d
    step = 1.0 / 10**d
    r = f"CAST(printf('%.{d}f', {x}) AS DOUBLE)"
    return f"(CASE WHEN {r} < {x} AND {x} - {r} = {half} THEN {r} + {step} ELSE {r} END)"


ORACLE["D3_driver_display"] = with_subscribers(f""", {GAINS},
top AS (SELECT feature, {R('importance', 6)} AS importance, rank FROM drivers WHERE rank <= 10)
SELECT rank, feature, {_js_round('importance * 100', 2)} AS importance_pct,
       {R('importance / GREATEST(MAX(importance) OVER (), 0.0001) * 100', 6)} AS bar_width_pct,
       rank <= 3 AS top_driver,
       CASE WHEN length(feature) > 22 THEN substr(feature, 1, 20) || '…' ELSE feature END AS short_name
FROM top""")

ORACLE["R5_risk_factors"] = with_subscribers(f""", {GAINS}, {SLOTS_BODY},
cand AS (SELECT c.cust_key, s.feature_index, s.feature, {R('i.importance', 6)} AS importance
         FROM cats c JOIN slot_names s ON c.col = s.col AND c.val = s.val JOIN imp i ON i.feature = s.feature
         WHERE i.importance > 0)
SELECT cust_key, CAST(rn AS INTEGER) AS factor_rank, feature, importance, CAST(1 AS DOUBLE) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY cust_key ORDER BY importance DESC, feature_index) AS rn FROM cand)
WHERE rn <= 5""")


# --- embeddings: given labels and centres ------------------------------------------
EMB = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
cen AS (SELECT label AS cid, list(mu ORDER BY d) AS c FROM (SELECT label, d, AVG(x) AS mu FROM u GROUP BY label, d)
        GROUP BY label)"""

ORACLE["K3_inertia"] = f"""WITH {EMB},
mu AS (SELECT label, d, AVG(x) AS m FROM u GROUP BY label, d)
SELECT {R('SUM((x - m) * (x - m))', 4)} AS inertia FROM u JOIN mu USING (label, d)"""

# Pairwise statement of the squared-Euclidean silhouette (fine for the small check table).
ORACLE["K4_silhouette"] = f"""WITH {EMB},
pd AS (SELECT a.vec_id, a.label AS own, b.label AS other, SUM(list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS tot,
              COUNT(*) AS cnt
       FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
per AS (SELECT vec_id, MAX(CASE WHEN other = own THEN tot / cnt END) AS a,
               MIN(CASE WHEN other <> own THEN tot / cnt END) AS b FROM pd GROUP BY vec_id),
s AS (SELECT e.vec_id, CASE WHEN per.a IS NULL OR per.b IS NULL THEN 0.0 ELSE (per.b - per.a) / GREATEST(per.a, per.b) END AS s
      FROM e LEFT JOIN per USING (vec_id))
SELECT {R('AVG(s)', 6)} AS silhouette FROM s"""

ORACLE["K6_assign_cluster"] = f"""WITH {EMB},
dist AS (SELECT e.vec_id, e.label, cen.cid, list_distance(e.v, cen.c) AS dd FROM e CROSS JOIN cen)
SELECT vec_id, label, CAST(cid AS INTEGER) AS cluster_id FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dd, cid) AS rn FROM dist) WHERE rn = 1"""

# --- sinks read back ---------------------------------------------------------------
ORACLE["S3_write_drivers"] = with_subscribers(
    f", {GAINS}\nSELECT feature, {R('importance', 6)} AS importance, rank FROM drivers WHERE rank <= 15")
ORACLE["S8_read_drivers"] = with_subscribers(
    f", {GAINS}\nSELECT feature, {R('importance', 6)} AS importance, rank FROM drivers WHERE rank <= 10")
_PROFILE_READ = f"""SELECT cluster_id, persona_name, count, {R('pct_of_customers', 6)} AS pct_of_customers,
       {R('avg_tenure', 6)} AS avg_tenure, {R('avg_monthly_charges', 6)} AS avg_monthly_charges,
       {R('avg_total_charges', 6)} AS avg_total_charges, {R('churn_rate', 6)} AS churn_rate, characteristics,
       top_contract, top_internet, top_payment FROM profiles ORDER BY cluster_id"""
ORACLE["S4_write_profiles"] = with_profiles(_PROFILE_READ)
ORACLE["S9_read_profiles"] = with_profiles(_PROFILE_READ)


# --- V3, V4, V8, F5, C4 ----------------------------------------------------------------
_TOTAL_NUM = PARSED
_RULES = [
    *[(f"{c}:required", f"{c} IS NULL") for c in
      ["senior_citizen", "partner", "dependents", "paperless_billing", "contract", "internet_service", "payment_method",
       "tenure", "monthly_charges", "total_charges", "churn"]],
    ("senior_citizen:min", "CAST(senior_citizen AS DOUBLE) < 0"),
    ("senior_citizen:max", "CAST(senior_citizen AS DOUBLE) > 1"),
    ("tenure:min", "CAST(tenure AS DOUBLE) < 0"),
    ("monthly_charges:min", "CAST(monthly_charges AS DOUBLE) < 0"),
    ("total_charges:numeric", f"total_charges IS NOT NULL AND ({_TOTAL_NUM}) IS NULL"),
    ("total_charges:min", f"({_TOTAL_NUM}) < 0"),
    ("partner:domain", "partner IS NOT NULL AND partner NOT IN ('Yes', 'No')"),
    ("dependents:domain", "dependents IS NOT NULL AND dependents NOT IN ('Yes', 'No')"),
    ("paperless_billing:domain", "paperless_billing IS NOT NULL AND paperless_billing NOT IN ('Yes', 'No')"),
    ("internet_service:domain", "internet_service IS NOT NULL AND internet_service NOT IN ('DSL', 'Fiber optic', 'No')"),
    ("contract:domain", "contract IS NOT NULL AND contract NOT IN ('Month-to-month', 'One year', 'Two year')"),
    ("payment_method:domain", "payment_method IS NOT NULL AND payment_method NOT IN ('Electronic check', 'Mailed check', "
                              "'Bank transfer (automatic)', 'Credit card (automatic)')"),
]

ORACLE["V3_rule_counts"] = f"WITH {SUBSCRIBERS_RAW}\n" + "\nUNION ALL\n".join(
    f"SELECT '{rule}' AS rule, CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_rows "
    f"FROM subscribers_raw" for rule, cond in _RULES)

ORACLE["V3_rejected_rows"] = f"WITH {SUBSCRIBERS_RAW}\n" + "\nUNION ALL\n".join(
    f"SELECT cust_key, '{rule}' AS rule FROM subscribers_raw WHERE {cond}" for rule, cond in _RULES)

ORACLE["V4_trim_flags"] = f"""WITH {SUBSCRIBERS_RAW}
SELECT cust_key, trim(partner) AS partner, trim(dependents) AS dependents, trim(paperless_billing) AS paperless_billing
FROM subscribers_raw"""

ORACLE["V8_prepare_xy"] = with_subscribers("""
SELECT cust_key, customer_id, senior_citizen, tenure, monthly_charges, total_charges, partner, dependents,
       paperless_billing, contract, internet_service, payment_method, churn FROM subscribers""")

ORACLE["F5_assemble"] = with_subscribers(f""", {SLOTS}
SELECT c.cust_key, s.feature_index, CASE WHEN c.val = s.val THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value
FROM cats c JOIN slot_names s ON c.col = s.col
UNION ALL SELECT cust_key, 0, CAST(senior_citizen AS DOUBLE) FROM subscribers
UNION ALL SELECT cust_key, 1, CAST(tenure AS DOUBLE) FROM subscribers
UNION ALL SELECT cust_key, 2, monthly_charges FROM subscribers
UNION ALL SELECT cust_key, 3, total_charges FROM subscribers""")

ORACLE["C4_disambiguate_names"] = with_profiles(
    "SELECT cluster_id, persona_name, contains(persona_name, ' (C') AS disambiguated FROM profiles")

ORACLE["Q14_list_customers_after"] = with_dash(f"""
SELECT customer_id, tenure, contract, monthly_charges, internet_service, churn, risk_level, persona_name, cluster_id,
       churn_probability {LISTING} AND customer_id > 'Customer#000000700' ORDER BY customer_id LIMIT 20""")


ORACLE["Q14_page_directory"] = with_dash("""
SELECT customer_id, tenure, contract, monthly_charges, internet_service, churn, risk_level, persona_name, cluster_id,
       churn_probability FROM dash ORDER BY customer_id LIMIT 20 OFFSET 780""")
ORACLE["Q9_search_index"] = ORACLE["Q9_search_customers"]
ORACLE["Q13_search_index"] = ORACLE["Q13_filter_persona"]


# --- evaluation on labelled documents ------------------------------------------------
DOC_SCORED = """scored AS (
  SELECT l.doc_id, l.quality AS label, CAST(d.n_chars AS DOUBLE) / (d.n_chars + CAST(1000 AS DOUBLE)) AS score,
         CAST(CAST(d.n_chars AS DOUBLE) / (d.n_chars + CAST(1000 AS DOUBLE)) > 0.5 AS INTEGER) AS prediction
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _on_documents(sql: str) -> str:
    return sql.replace(f"WITH {RULE_SCORED}", f"WITH {DOC_SCORED}", 1)


for _k in ("E1_confusion_matrix", "E3_roc_auc", "E4_roc_curve", "E5_classification_report"):
    ORACLE[f"{_k}_documents"] = _on_documents(ORACLE[_k])

ORACLE["V6_cast_int"] = f"""WITH {SUBSCRIBERS_RAW}
SELECT cust_key, CAST(senior_citizen AS INTEGER) AS senior_citizen FROM subscribers_raw"""
