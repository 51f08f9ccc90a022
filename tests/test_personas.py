"""Profiles, persona names and their display."""

from churnlens.operators import personas as P


def _rows(cluster, n, tenure, monthly, churn, contract, partner="Yes"):
    return [(cluster, 0, partner, "No", "Yes", contract, "DSL", "Mailed check", tenure, monthly, monthly * tenure, churn)
            for _ in range(n)]


SCHEMA = ("cluster_id int, senior_citizen int, partner string, dependents string, paperless_billing string, "
          "contract string, internet_service string, payment_method string, tenure int, monthly_charges double, "
          "total_charges double, churn int")


def test_profiles_names_and_ties(spark):
    rows = (_rows(0, 2, 10, 50.0, 1, "One year") + _rows(0, 2, 10, 50.0, 1, "Month-to-month")  # tied contract mode
            + _rows(1, 4, 10, 50.0, 1, "Two year")  # same stats as cluster 0 -> same auto-name
            + _rows(2, 4, 60, 90.0, 0, "Two year", partner="No"))
    df = spark.createDataFrame(rows, SCHEMA)
    prof = {r.cluster_id: r for r in P.cluster_profiles(df).collect()}
    assert prof[0].top_contract == "Month-to-month"  # lowest value wins a tied mode
    # global tenure mean 26.67: 10 < 0.7 x mean -> New; 60 > 1.3 x mean -> Loyal
    assert prof[0].persona_name == "New Value High-Risk Customers (C0)"
    assert prof[1].persona_name == "New Value High-Risk Customers (C1)"
    assert prof[2].persona_name == "Loyal High-Spend Low-Risk Customers"
    assert abs(prof[2].pct_of_customers - 1 / 3) < 1e-12
    assert prof[2].characteristics == ("Avg tenure 60.0 months | Avg monthly charges $90.00 | Most common contract: Two year"
                                       " | Most common internet: DSL | Churn rate 0.0% | Senior citizens 0.0% | Have partner 0.0%")
    parts = P.split_characteristics(P.cluster_profiles(df)).filter("cluster_id = 2").orderBy("position").collect()
    assert len(parts) == 7 and parts[4].statement == "Churn rate 0.0%"
    disp = {r.cluster_id: r for r in P.persona_display(P.cluster_profiles(df)).collect()}
    assert disp[0].high_churn and not disp[2].high_churn and disp[2].share_pct == 33.3
