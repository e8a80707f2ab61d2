"""The same questions in plain SQL, for an independent engine over the same tables."""

from __future__ import annotations

# Shared building blocks, in dependency order.
CTES: dict[str, str] = {
    "pred": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS customer_id,
               least(value, 100.0) / 100.0 AS churn_probability,
               CASE WHEN least(value, 100.0) / 100.0 >= 0.5 THEN 'Yes' ELSE 'No' END AS prediction,
               CAST(CASE WHEN k >= 50 THEN 1 ELSE 0 END AS BIGINT) AS actual_churn,
               date_trunc('second', ts) AS processed_ts,
               CASE WHEN k % 7 <> 0 THEN 'v' || CAST(k % 5 AS VARCHAR) END AS model_version,
               event_type AS contract, k, value, user_id, ts
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "ref": "SELECT * FROM pred WHERE processed_ts < TIMESTAMP '2024-01-16'",
    "cur": "SELECT * FROM pred WHERE processed_ts >= TIMESTAMP '2024-01-16'",
    "cust": """
        SELECT CAST(c_custkey AS VARCHAR) AS "customerID", o.tenure, o."MonthlyCharges", o."TotalCharges",
               CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS "SeniorCitizen",
               CAST(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS BIGINT) AS "PaperlessBilling",
               c_mktsegment AS "Contract", r_name AS "Region",
               CAST(CASE WHEN last_order < TIMESTAMP '2000-10-01' THEN 1 ELSE 0 END AS BIGINT) AS churn,
               c_custkey AS ck
        FROM customer
        JOIN (SELECT o_custkey,
                     CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS DOUBLE) AS tenure,
                     ((2 * CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*))) / 100.0 AS "MonthlyCharges",
                     CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100.0 AS "TotalCharges",
                     max(o_orderdate) AS last_order
              FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    # The cleaned values follow from how the raw text was made, not from parsing it.
    "raw": """
        SELECT "customerID", ck,
               CASE WHEN ck % 101 <> 100 THEN tenure END AS tenure,
               "MonthlyCharges",
               CASE WHEN ck % 11 = 0 OR ck % 13 = 0 OR ck % 17 = 0 THEN 0.0 ELSE "TotalCharges" END AS "TotalCharges",
               CASE WHEN ck % 103 <> 102 THEN "SeniorCitizen" END AS "SeniorCitizen",
               CASE WHEN ck % 107 <> 106 THEN "PaperlessBilling" END AS "PaperlessBilling",
               "Contract", "Region", churn
        FROM cust""",
    "clean": """
        SELECT *, CASE WHEN tenure IS NULL THEN 'ValueError: tenure: not a number'
                       WHEN "PaperlessBilling" IS NULL THEN 'ValueError: PaperlessBilling: expected Yes or No'
                       WHEN "SeniorCitizen" IS NULL THEN 'ValueError: SeniorCitizen: not an integer' END AS clean_error
        FROM raw""",
    "routed": """
        SELECT *, CASE WHEN error IS NULL THEN round(value / 100.0, 4) END AS p,
               CASE WHEN error IS NULL THEN CASE WHEN value / 100.0 >= 0.5 THEN 'Yes' ELSE 'No' END END AS label
        FROM (SELECT *,
                     CASE WHEN event_id % 97 = 0 THEN 'json_parse_error: not valid JSON'
                          WHEN event_id % 89 = 0 THEN 'ValidationError: missing required fields: [''Region'', ''tenure'']'
                          WHEN event_id % 83 = 0 THEN 'ValidationError: event is not a JSON object'
                          WHEN event_id % 79 = 0 THEN 'ValueError: PaperlessBilling: expected Yes or No'
                          WHEN value > 100 THEN 'ValueError: probability out of range' END AS error,
                     CASE WHEN event_id % 97 = 0 THEN FALSE
                          WHEN event_id % 89 = 0 THEN TRUE
                          WHEN event_id % 83 = 0 THEN FALSE ELSE TRUE END AS readable
              FROM pred)""",
    "labelled": """
        SELECT l.doc_id, CAST(quality AS BIGINT) AS y, least(n_chars, 10000) / 10000.0 AS p,
               CASE WHEN least(n_chars, 10000) / 10000.0 >= 0.1 THEN 1 ELSE 0 END AS predicted
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "scores": """
        SELECT p, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS neg
        FROM labelled GROUP BY p""",
    "curve": """
        SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tps, sum(neg) OVER (ORDER BY p DESC) AS fps,
               sum(neg) OVER (ORDER BY p) - neg AS neg_below,
               sum(pos) OVER () AS np, sum(neg) OVER () AS nn
        FROM scores""",
    "cells": """
        SELECT count(*) FILTER (y = 0 AND predicted = 0) AS tn, count(*) FILTER (y = 0 AND predicted = 1) AS fp,
               count(*) FILTER (y = 1 AND predicted = 0) AS fn, count(*) FILTER (y = 1 AND predicted = 1) AS tp
        FROM labelled""",
    "day_scores": """
        SELECT strftime(processed_ts, '%Y-%m-%d') AS day, churn_probability AS p,
               sum(actual_churn) AS pos, sum(1 - actual_churn) AS neg
        FROM pred GROUP BY ALL""",
    "day_auc": """
        SELECT day, sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc
        FROM (SELECT *, sum(neg) OVER (PARTITION BY day ORDER BY p) - neg AS below FROM day_scores) GROUP BY day""",
    "day_cells": """
        SELECT strftime(processed_ts, '%Y-%m-%d') AS day, count(*) AS n,
               count(*) FILTER (actual_churn = 0 AND prediction = 'No') AS tn,
               count(*) FILTER (actual_churn = 0 AND prediction = 'Yes') AS fp,
               count(*) FILTER (actual_churn = 1 AND prediction = 'No') AS fn,
               count(*) FILTER (actual_churn = 1 AND prediction = 'Yes') AS tp
        FROM pred GROUP BY 1""",
    "perf": """
        SELECT c.day AS computed_at, n AS sample_size, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy,
               CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / CAST(tp + fp AS DOUBLE), 6) END AS precision,
               CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / CAST(tp + fn AS DOUBLE), 6) END AS recall,
               CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) END AS f1,
               round(a.roc_auc, 6) AS roc_auc
        FROM day_cells c JOIN day_auc a ON c.day = a.day""",
    "perf_rows": """
        SELECT computed_at, sample_size, 'accuracy' AS metric_name, accuracy AS metric_value FROM perf
        UNION ALL SELECT computed_at, sample_size, 'precision', precision FROM perf
        UNION ALL SELECT computed_at, sample_size, 'recall', recall FROM perf
        UNION ALL SELECT computed_at, sample_size, 'f1', f1 FROM perf
        UNION ALL SELECT computed_at, sample_size, 'roc_auc', roc_auc FROM perf""",
    "shares": """
        SELECT d.day, d.contract, d.n, t.day_n, c.all_n / CAST(w.n AS DOUBLE) AS r, d.n / CAST(t.day_n AS DOUBLE) AS c
        FROM (SELECT strftime(processed_ts, '%Y-%m-%d') AS day, contract, count(*) AS n FROM pred GROUP BY ALL) d
        JOIN (SELECT strftime(processed_ts, '%Y-%m-%d') AS day, count(*) AS day_n FROM pred GROUP BY 1) t ON d.day = t.day
        JOIN (SELECT contract, count(*) AS all_n FROM pred GROUP BY 1) c ON d.contract = c.contract
        CROSS JOIN (SELECT count(*) AS n FROM pred) w""",
    "yes_shares": """
        SELECT strftime(processed_ts, '%Y-%m-%d') AS day,
               count(*) FILTER (prediction = 'Yes') / CAST(count(*) AS DOUBLE) AS c,
               (SELECT count(*) FILTER (prediction = 'Yes') / CAST(count(*) AS DOUBLE) FROM pred) AS r
        FROM pred GROUP BY 1""",
    "dm": """
        SELECT *, statistic_value >= threshold AS is_drifted FROM (
        SELECT day AS computed_at, contract AS feature_name, 'data' AS drift_type, 'psi' AS statistic_name,
               round((c - r) * ln(c / r), 6) AS statistic_value, CAST(0.005 AS DOUBLE) AS threshold FROM shares
        UNION ALL SELECT day, contract, 'data', 'ks', round(abs(c - r), 6), 0.03 FROM shares
        UNION ALL SELECT day, contract, 'data', 'chi_square', round(pow(n - day_n * r, 2) / (day_n * r), 6), 3.0 FROM shares
        UNION ALL SELECT day, NULL, 'prediction', 'psi',
               round((c - r) * ln(c / r) + (r - c) * ln((1 - c) / (1 - r)), 6), 0.002 FROM yes_shares)""",
    "fired": """
        SELECT computed_at,
               CASE WHEN statistic_value / threshold >= 2.0 THEN 'critical'
                    WHEN statistic_value / threshold >= 1.2 THEN 'warning' ELSE 'info' END AS severity,
               'drift' AS category,
               CASE WHEN drift_type = 'prediction'
                    THEN printf('scores moved: psi %.4f reaches %.4f (%s)', statistic_value, threshold,
                         CASE WHEN statistic_value < 0.1 THEN 'none' WHEN statistic_value < 0.25 THEN 'moderate' ELSE 'significant' END)
                    ELSE printf('column %s moved: %s %.4f reaches %.4f', feature_name, statistic_name, statistic_value, threshold)
               END AS message, statistic_value AS metric_value, threshold
        FROM dm WHERE is_drifted
        UNION ALL
        SELECT computed_at,
               CASE WHEN 1.0 + greatest(0.0, 0.55 - 0.05 - roc_auc) / 0.05 >= 2.0 THEN 'critical'
                    WHEN 1.0 + greatest(0.0, 0.55 - 0.05 - roc_auc) / 0.05 >= 1.2 THEN 'warning' ELSE 'info' END,
               'performance', printf('model below its floor: area %.4f', roc_auc), roc_auc, 0.55
        FROM perf WHERE roc_auc < 0.5
        UNION ALL
        SELECT computed_at, CASE WHEN 1.0 + (320.0 - n) / 320.0 >= 2.0 THEN 'critical'
                    WHEN 1.0 + (320.0 - n) / 320.0 >= 1.2 THEN 'warning' ELSE 'info' END,
               'volume', printf('too few records: %d, at least 320 expected', n),
               CAST(n AS DOUBLE), 320.0
        FROM (SELECT day AS computed_at, n FROM day_cells) WHERE n < 320
        UNION ALL
        SELECT computed_at, CASE WHEN n / 350.0 >= 2.0 THEN 'critical' WHEN n / 350.0 >= 1.2 THEN 'warning' ELSE 'info' END,
               'volume', printf('too many records: %d, at most 350 expected', n),
               CAST(n AS DOUBLE), 350.0
        FROM (SELECT day AS computed_at, n FROM day_cells) WHERE n > 350""",
    "numeric_long": """
        SELECT 'churn_probability' AS feature, churn_probability AS v, 0 AS side FROM ref
        UNION ALL SELECT 'churn_probability', churn_probability, 1 FROM cur
        UNION ALL SELECT 'actual_churn', CAST(actual_churn AS DOUBLE), 0 FROM ref
        UNION ALL SELECT 'actual_churn', CAST(actual_churn AS DOUBLE), 1 FROM cur""",
    "sizes": """
        SELECT feature, count(*) FILTER (side = 0) AS n_reference, count(*) FILTER (side = 1) AS n_current
        FROM numeric_long GROUP BY feature""",
    "points": """
        SELECT feature, q, row_number() OVER (PARTITION BY feature ORDER BY q) AS i, count(*) OVER (PARTITION BY feature) AS n_points
        FROM (SELECT DISTINCT feature, q FROM (SELECT feature, unnest(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS q
              FROM numeric_long WHERE side = 0 GROUP BY feature))""",
    "buckets": """
        SELECT feature, bucket, max(n_points) AS n_points, sum(rn) AS rn, sum(cn) AS cn
        FROM (SELECT c.feature, c.v, any_value(rn) AS rn, any_value(cn) AS cn, max(n_points) AS n_points,
                     count(*) FILTER (i > 1 AND i < n_points AND q <= c.v) AS bucket
              FROM (SELECT feature, v, count(*) FILTER (side = 0) AS rn, count(*) FILTER (side = 1) AS cn
                    FROM numeric_long GROUP BY ALL) c
              JOIN points p ON c.feature = p.feature GROUP BY c.feature, c.v) GROUP BY feature, bucket""",
    "num_psi": """
        SELECT s.feature, any_value(n_reference) AS n_reference, any_value(n_current) AS n_current,
               sum(CASE WHEN n_points < 3 THEN 0.0 ELSE
                   (greatest(cn / CAST(n_current AS DOUBLE), 1e-6) - greatest(rn / CAST(n_reference AS DOUBLE), 1e-6))
                   * ln(greatest(cn / CAST(n_current AS DOUBLE), 1e-6) / greatest(rn / CAST(n_reference AS DOUBLE), 1e-6)) END) AS psi
        FROM buckets b JOIN sizes s ON b.feature = s.feature GROUP BY s.feature""",
    "ks": """
        SELECT feature, max(abs(a / CAST(n AS DOUBLE) - b / CAST(m AS DOUBLE))) AS d, any_value(n) AS n, any_value(m) AS m
        FROM (SELECT feature, sum(rn) OVER (PARTITION BY feature ORDER BY v) AS a, sum(cn) OVER (PARTITION BY feature ORDER BY v) AS b,
                     sum(rn) OVER (PARTITION BY feature) AS n, sum(cn) OVER (PARTITION BY feature) AS m
              FROM (SELECT feature, v, count(*) FILTER (side = 0) AS rn, count(*) FILTER (side = 1) AS cn
                    FROM numeric_long GROUP BY ALL)) GROUP BY feature""",
    "ks_tail": """
        SELECT feature, any_value(d) AS d, any_value(n) AS n, any_value(m) AS m,
               CASE WHEN any_value(n) < 2 OR any_value(m) < 2 OR any_value(lam) < 0.2 THEN 1.0 ELSE
               least(1.0, greatest(0.0, 2 * sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * lam * lam)))) END AS p
        FROM (SELECT *, (sqrt(n * m / CAST(n + m AS DOUBLE)) + 0.12 + 0.11 / sqrt(n * m / CAST(n + m AS DOUBLE))) * d AS lam FROM ks)
        CROSS JOIN (SELECT unnest(range(1, 101)) AS j) GROUP BY feature""",
    "cat_long": """
        SELECT 'contract' AS feature, contract AS v, 0 AS side FROM ref UNION ALL SELECT 'contract', contract, 1 FROM cur
        UNION ALL SELECT 'model_version', model_version, 0 FROM ref UNION ALL SELECT 'model_version', model_version, 1 FROM cur""",
    "cat_counts": """
        SELECT feature, v, count(*) FILTER (side = 0) AS rn, count(*) FILTER (side = 1) AS cn FROM cat_long GROUP BY ALL""",
    "cat_totals": """
        SELECT feature, sum(rn) AS ref_rows, sum(cn) AS cur_rows, sum(rn) FILTER (v IS NOT NULL) AS rv,
               sum(cn) FILTER (v IS NOT NULL) AS cv, count(v) AS k FROM cat_counts GROUP BY feature""",
    "cat_stats": """
        SELECT c.feature, any_value(k) - 1 AS dof,
               sum((greatest(cn / CAST(cur_rows AS DOUBLE), 1e-6) - greatest(rn / CAST(ref_rows AS DOUBLE), 1e-6))
                   * ln(greatest(cn / CAST(cur_rows AS DOUBLE), 1e-6) / greatest(rn / CAST(ref_rows AS DOUBLE), 1e-6))) AS psi,
               sum(pow(rn - (rn + cn) * rv / CAST(rv + cv AS DOUBLE), 2) / ((rn + cn) * rv / CAST(rv + cv AS DOUBLE))
                 + pow(cn - (rn + cn) * cv / CAST(rv + cv AS DOUBLE), 2) / ((rn + cn) * cv / CAST(rv + cv AS DOUBLE))) AS chi
        FROM cat_counts c JOIN cat_totals t ON c.feature = t.feature WHERE v IS NOT NULL GROUP BY c.feature""",
    # Both monitored categories have five values, so the tail has a closed form.
    "drift_rows": """
        SELECT NULL AS feature_name, 'prediction' AS drift_type, 'psi' AS statistic_name, round(psi, 6) AS statistic_value,
               CAST(0.25 AS DOUBLE) AS threshold, psi >= 0.25 AS is_drifted, CAST(NULL AS DOUBLE) AS p_value
        FROM num_psi WHERE feature = 'churn_probability'
        UNION ALL SELECT NULL, 'prediction', 'ks', round(d, 6), 0.05, p < 0.05, round(p, 6)
        FROM ks_tail WHERE feature = 'churn_probability'
        UNION ALL SELECT feature, 'data', 'psi', round(psi, 6), 0.25, psi >= 0.25, NULL
        FROM num_psi WHERE feature = 'churn_probability'
        UNION ALL SELECT feature, 'data', 'psi', round(psi, 6), 0.25, psi >= 0.25, NULL FROM cat_stats
        UNION ALL SELECT feature, 'data', 'chi_square', round(chi, 6), 0.05, exp(-chi / 2) * (1 + chi / 2) < 0.05,
               round(exp(-chi / 2) * (1 + chi / 2), 6) FROM cat_stats""",
    "latest": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY processed_ts DESC, event_id DESC) AS rn FROM pred)
        WHERE rn = 1""",
    "split_hash": """
        SELECT *, CASE WHEN h < 'b3333333' THEN 'train' WHEN h < 'd999999a' THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, substr(md5("customerID" || ':42'), 1, 8) AS h FROM cust)""",
    "messages": """
        SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 41 <> 0 THEN customer_id END AS customer_id,
               CASE WHEN event_id % 43 <> 0 THEN round(churn_probability, 4) END AS churn_probability, prediction,
               CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 1 THEN 0 END AS actual_churn,
               CASE WHEN event_id % 10 <> 0 THEN processed_ts END AS processed_ts,
               CASE WHEN event_id % 3 = 0 THEN contract END AS contract
        FROM pred""",
    "up": """
        SELECT event_id, customer_id, prediction, churn_probability,
               CASE WHEN event_id % 25 <> 0 THEN date_trunc('hour', processed_ts) END AS h, processed_ts FROM pred""",
    "version_metrics": """
        SELECT user_id AS version, arg_max(least(value, 100.0) / 100.0, event_id) AS metric FROM events GROUP BY user_id""",
    "z": """
        SELECT "customerID", round((tenure - a) / b, 6) AS tenure, round(("MonthlyCharges" - c) / d, 6) AS "MonthlyCharges",
               round(("TotalCharges" - e) / f, 6) AS "TotalCharges"
        FROM cust CROSS JOIN (SELECT avg(tenure) AS a, stddev_samp(tenure) AS b, avg("MonthlyCharges") AS c,
             stddev_samp("MonthlyCharges") AS d, avg("TotalCharges") AS e, stddev_samp("TotalCharges") AS f FROM cust)""",
}

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


def _sql(body: str) -> str:
    """Puts the building blocks a query needs in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and _mentions(text, name):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    ordered = [n for n in CTES if n in needed]
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + body


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(
        w == name and i and words[i - 1].upper() in ("FROM", "JOIN") for i, w in enumerate(words)
    )


_CLEAN_COLUMNS = '"customerID", tenure, "MonthlyCharges", "TotalCharges", "SeniorCitizen", "PaperlessBilling", "Contract", "Region", churn'
_FEATURES = '"customerID", tenure, "MonthlyCharges", "TotalCharges", "SeniorCitizen", "PaperlessBilling", "Contract", "Region"'
_RATE = "round(100.0 * count(*) FILTER (prediction = 'Yes') / count(*), 2)"


def _cents(c: str) -> str:
    return f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR) || 'e-2'"


def _kpis(where: str, p: str) -> str:
    return (
        f"count(*) FILTER ({where}) AS {p}total, "
        f"100.0 * count(*) FILTER ({where} AND prediction = 'Yes') / nullif(count(*) FILTER ({where}), 0) AS {p}rate, "
        f"avg(churn_probability) FILTER ({where}) AS {p}avg, "
        f"count(*) FILTER ({where} AND churn_probability > 0.7) AS {p}high"
    )


BODIES: dict[str, str] = {
    "clean_strip": f"""
        SELECT "customerID", CASE WHEN ck % 101 = 100 THEN 'abc' ELSE CAST(CAST(tenure AS BIGINT) AS VARCHAR) END AS tenure,
               {_cents('"MonthlyCharges"')} AS "MonthlyCharges",
               CASE WHEN ck % 11 = 0 THEN '' WHEN ck % 13 = 0 THEN 'n/a' WHEN ck % 17 = 0 THEN 'NaN'
                    ELSE {_cents('"TotalCharges"')} END AS "TotalCharges",
               CASE WHEN ck % 103 <> 102 THEN CAST("SeniorCitizen" AS VARCHAR) END AS "SeniorCitizen",
               CASE WHEN ck % 107 = 106 THEN 'Maybe' WHEN "PaperlessBilling" = 1 THEN 'Yes' ELSE 'No' END AS "PaperlessBilling",
               "Contract", "Region", CASE WHEN churn = 1 THEN 'Yes' ELSE 'No' END AS "Churn"
        FROM cust""",
    "clean_lenient_numeric": 'SELECT "customerID", "TotalCharges" FROM raw',
    "clean_yes_no": 'SELECT "customerID", "PaperlessBilling", churn FROM raw',
    "clean_table": f"SELECT {_CLEAN_COLUMNS}, clean_error FROM clean",
    "null_profile": """
        SELECT * FROM (SELECT 'tenure' AS column_name, count(*) - count(tenure) AS null_count FROM raw
        UNION ALL SELECT 'PaperlessBilling', count(*) - count("PaperlessBilling") FROM raw
        UNION ALL SELECT 'SeniorCitizen', count(*) - count("SeniorCitizen") FROM raw) WHERE null_count > 0""",
    "quality_report": """
        SELECT 'not_null' AS rule, 'tenure' AS column_name, count(*) - count(tenure) AS violations FROM raw
        UNION ALL SELECT 'not_null', 'MonthlyCharges', count(*) - count("MonthlyCharges") FROM raw
        UNION ALL SELECT 'not_null', 'TotalCharges', count(*) - count("TotalCharges") FROM raw
        UNION ALL SELECT 'not_null', 'SeniorCitizen', count(*) - count("SeniorCitizen") FROM raw
        UNION ALL SELECT 'not_null', 'PaperlessBilling', count(*) - count("PaperlessBilling") FROM raw
        UNION ALL SELECT 'not_null', 'Contract', count(*) - count("Contract") FROM raw
        UNION ALL SELECT 'not_null', 'Region', count(*) - count("Region") FROM raw
        UNION ALL SELECT 'not_null', 'churn', count(*) - count(churn) FROM raw
        UNION ALL SELECT 'not_null', 'customerID', count(*) - count("customerID") FROM raw
        UNION ALL SELECT 'domain', 'churn', count(*) - count(*) FILTER (churn IN (0, 1)) FROM raw
        UNION ALL SELECT 'unique', 'customerID', count(*) - count(DISTINCT "customerID") FROM raw
        UNION ALL SELECT 'min_rows', '*', CAST(CASE WHEN count(*) < 100 THEN 1 ELSE 0 END AS BIGINT) FROM raw""",
    "range_rules": """
        SELECT "customerID", concat_ws(',', CASE WHEN tenure - 1500 < 0 THEN 'tenure_not_negative' END,
               CASE WHEN "MonthlyCharges" / 200000.0 > 1 THEN 'threshold_in_unit' END) AS broken_rules FROM cust""",
    "feature_projection": f"SELECT {_FEATURES} FROM cust",
    "fill_missing_columns": """
        SELECT "customerID", tenure, "MonthlyCharges", CAST(0.0 AS DOUBLE) AS "TotalCharges",
               CAST(0 AS BIGINT) AS "SeniorCitizen", "PaperlessBilling", "Contract", 'No' AS "Region" FROM cust""",
    "score_records": """
        SELECT "customerID", tenure, "MonthlyCharges", "TotalCharges", "SeniorCitizen", "PaperlessBilling", "Contract",
               "Region", CASE WHEN p >= 0.5 THEN 'Yes' ELSE 'No' END AS label,
               round_even(CAST(p * 10000 AS DOUBLE), 0) / 10000 AS churn_probability
        FROM (SELECT * EXCLUDE (ck), least(CAST(tenure AS BIGINT) % 32 + 16 * "SeniorCitizen"
                         + CASE WHEN "Region" = 'No' THEN 8 ELSE length("Region") % 8 END, 64) / 64.0 AS p
              FROM (SELECT * REPLACE (CASE WHEN ck % 3 < 2 THEN "TotalCharges" ELSE CAST(0 AS DOUBLE) END AS "TotalCharges",
                                      CASE WHEN ck % 3 < 2 THEN "SeniorCitizen" ELSE CAST(0 AS BIGINT) END AS "SeniorCitizen",
                                      CASE WHEN ck % 3 < 2 THEN "Region" ELSE 'No' END AS "Region")
                    FROM cust) AS given) AS scored""",
    "normalize_ground_truth": """
        SELECT "customerID", CASE WHEN "PaperlessBilling" = 1 THEN 'Yes' WHEN "PaperlessBilling" = 0 THEN 'No' END AS label,
               "PaperlessBilling" AS label_int FROM raw""",
    "threshold_label": """
        SELECT event_id, round(churn_probability / 3.0, 4) AS churn_probability, t AS threshold,
               CASE WHEN churn_probability / 3.0 >= t THEN 'Yes' ELSE 'No' END AS prediction
        FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / 10.0 ELSE 0.5 END AS t FROM pred)""",
    "parse_timestamps": f"""
        SELECT event_id, CASE WHEN event_id % 5 = 1 THEN {_ISO.format("ts - INTERVAL 2 HOUR")}
                              WHEN event_id % 5 IN (0, 2) THEN {_ISO.format("ts")} END AS parsed FROM events""",
    "message_to_row": f"""
        SELECT event_id, customer_id, churn_probability, CAST(actual_churn AS BIGINT) AS actual_churn,
               {_ISO.format("processed_ts")} AS processed_ts, contract,
               CASE WHEN customer_id IS NULL THEN 'unusable customer_id'
                    WHEN churn_probability IS NULL THEN 'unusable churn_probability' END AS row_error FROM messages""",
    "risk_band": """
        SELECT CASE WHEN p IS NULL THEN 'unknown' WHEN p > 0.7 THEN 'high' WHEN p > 0.4 THEN 'medium' ELSE 'low' END AS risk,
               count(*) AS n FROM (SELECT CASE WHEN event_id % 50 <> 0 THEN churn_probability END AS p FROM pred) GROUP BY 1""",
    "segment_filter": "SELECT event_id, contract FROM pred WHERE contract IN ('click', 'view')",
    "encode_events": """
        SELECT customer_id AS key, '{"customer_id":"' || customer_id || '","contract":"' || contract || '","actual_churn":'
               || actual_churn || ',"p":' || CASE WHEN event_id % 10 = 0 THEN 'null' ELSE '0.5' END || ',"event_id":' || event_id
               || ',"event_ts":"2024-02-01T00:00:00Z"}' AS value FROM pred""",
    "route_events": """
        SELECT event_id, CASE WHEN readable THEN customer_id END AS event_key, p AS churn_probability, label AS prediction,
               CASE WHEN readable THEN CASE WHEN actual_churn = 1 THEN 'Yes' ELSE 'No' END END AS actual, error FROM routed""",
    "stream_counters": """
        SELECT CAST(floor(event_id / 1000) AS BIGINT) AS batch, count(*) AS consumed,
               count(*) FILTER (error IS NULL) AS predicted, count(*) FILTER (error IS NOT NULL) AS dead_lettered
        FROM routed GROUP BY 1""",
    "resume_publish": """
        SELECT customer_id AS key, '{"event_id":' || event_id || ',"customer_id":"' || customer_id || '","contract":"' || contract
               || '","event_ts":"2024-02-01T00:00:00Z"}' AS value
        FROM pred WHERE event_id > (SELECT max(event_id) FROM ref)""",
    "stratified_split": 'SELECT "customerID", split FROM split_hash',
    "stratified_split_exact": """
        SELECT "customerID", churn, CASE WHEN r <= floor(n * 0.7 + 0.5) THEN 'train' WHEN r <= floor(n * (0.7 + 0.15) + 0.5) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT "customerID", churn, count(*) OVER (PARTITION BY churn) AS n,
                     row_number() OVER (PARTITION BY churn ORDER BY substr(md5("customerID" || ':42'), 1, 15)) AS r FROM cust)""",
    "split_stats": """
        SELECT coalesce(split, 'total') AS split, count(*) AS n_rows, CAST(sum(churn) AS BIGINT) AS n_positive,
               round(avg(churn) * 100, 4) AS positive_pct FROM split_hash GROUP BY ROLLUP (split)""",
    "split_overlap": "SELECT CAST(0 AS BIGINT) AS shared_keys, count(DISTINCT customer_id) AS keys FROM pred",
    "sample_fraction": """
        SELECT "customerID", churn FROM cust WHERE substr(md5("customerID" || '|42'), 1, 8) < '19999999'""",
    "class_weights": """
        SELECT churn, n, round(sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE), 6) AS weight
        FROM (SELECT churn, count(*) AS n FROM cust GROUP BY churn)""",
    "confusion_matrix": "SELECT tn, fp, fn, tp FROM cells",
    "classification_metrics": """
        SELECT round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision,
               round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM cells""",
    "roc_auc": "SELECT round(sum(pos * (neg_below + neg / 2.0)) / (CAST(max(np) AS DOUBLE) * max(nn)), 6) AS roc_auc FROM curve",
    "roc_auc_events": """
        SELECT round(sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc
        FROM (SELECT *, sum(neg) OVER (ORDER BY churn_probability) - neg AS below
              FROM (SELECT churn_probability, sum(actual_churn) AS pos, sum(1 - actual_churn) AS neg FROM pred GROUP BY 1))""",
    "average_precision": "SELECT round(sum(pos / CAST(np AS DOUBLE) * tps / (tps + fps)), 6) AS average_precision FROM curve",
    "pr_auc_trapezoid": """
        SELECT round(sum(pos / CAST(np AS DOUBLE) * (tps / CAST(tps + fps AS DOUBLE)
               + CASE WHEN tps + fps - pos - neg = 0 THEN tps / CAST(tps + fps AS DOUBLE)
                      ELSE (tps - pos) / CAST(tps + fps - pos - neg AS DOUBLE) END) / 2.0), 6) AS pr_auc FROM curve""",
    "roc_curve": """
        SELECT round(p, 6) AS threshold, round(fps / CAST(nn AS DOUBLE), 6) AS fpr, round(tps / CAST(np AS DOUBLE), 6) AS tpr FROM curve""",
    "pr_curve": """
        SELECT round(p, 6) AS threshold, round(tps / CAST(tps + fps AS DOUBLE), 6) AS precision,
               round(tps / CAST(np AS DOUBLE), 6) AS recall, round(np / CAST(np + nn AS DOUBLE), 6) AS prevalence FROM curve""",
    "performance_report": f"""
        SELECT TRUE AS has_ground_truth, n AS sample_size, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy,
               round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
               round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round(a.roc_auc, 6) AS roc_auc,
               a.roc_auc < 0.75 AS degraded, CAST(0.8 AS DOUBLE) AS baseline_roc_auc, CAST(0.05 AS DOUBLE) AS degradation_tolerance,
               {_ISO.format("w0")} AS window_start, {_ISO.format("w1")} AS window_end
        FROM (SELECT CAST(sum(n) AS BIGINT) AS n, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM day_cells)
        CROSS JOIN (SELECT sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc
              FROM (SELECT *, sum(neg) OVER (ORDER BY churn_probability) - neg AS below
                    FROM (SELECT churn_probability, sum(actual_churn) AS pos, sum(1 - actual_churn) AS neg FROM pred GROUP BY 1))) a
        CROSS JOIN (SELECT min(processed_ts) AS w0, max(processed_ts) AS w1 FROM pred)""",
    "quality_gate": """
        SELECT computed_at, sample_size, metric_name, metric_value, minimum, metric_value >= minimum AS passed
        FROM (SELECT *, CAST(CASE metric_name WHEN 'accuracy' THEN 0.5 WHEN 'recall' THEN 0.1 WHEN 'roc_auc' THEN 0.5 END AS DOUBLE) AS minimum
              FROM perf_rows) WHERE minimum IS NOT NULL""",
    "drift_numeric_psi": """
        SELECT feature, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS psi_band,
               n_reference, n_current FROM num_psi""",
    "drift_sketched_psi": """
        SELECT feature, n_reference, n_current, round(psi, 6) AS exact_psi, TRUE AS within_error FROM num_psi""",
    "drift_categorical_psi": "SELECT feature, round(psi, 6) AS psi FROM cat_stats",
    "drift_ks": "SELECT feature, round(d, 6) AS ks_d, CAST(n AS BIGINT) AS n_reference, CAST(m AS BIGINT) AS n_current FROM ks",
    "drift_ks_p": "SELECT feature, round(p, 6) AS p_value FROM ks_tail",
    "drift_chi_square": """
        SELECT feature, round(chi, 6) AS chi_square, dof, round(exp(-chi / 2) * (1 + chi / 2), 6) AS p_value FROM cat_stats""",
    "prediction_drift": """
        SELECT feature_name, drift_type, statistic_name, statistic_value, threshold, is_drifted, p_value,
               'last ' || (SELECT count(*) FROM cur) || ' predictions' AS current_window
        FROM drift_rows WHERE drift_type = 'prediction'""",
    "data_drift": "SELECT * FROM drift_rows WHERE drift_type = 'data'",
    "drift_report": """
        SELECT drift_type, statistic_name, count(*) AS n, count(*) FILTER (is_drifted) AS n_drifted FROM drift_rows GROUP BY ALL""",
    "consume_records": """
        SELECT CASE WHEN error IS NULL THEN 'predictions' ELSE 'dead_letters' END AS "table",
               coalesce(error, label) AS outcome, count(*) AS n, count(*) AS n_places FROM routed GROUP BY ALL""",
    "monitoring_cycle": """
        SELECT concat_ws('/', drift_type, statistic_name, feature_name) AS name, round(statistic_value, 4) AS value,
               is_drifted AS flag, CAST(NULL AS BIGINT) AS n FROM drift_rows
        UNION ALL
        SELECT 'performance/' || name, round(value, 4), NULL, n
        FROM (SELECT n, unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) AS name,
                     unnest([(tp + tn) / CAST(n AS DOUBLE), tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE),
                             2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), area]) AS value
              FROM (SELECT count(*) AS n, count(*) FILTER (actual_churn = 1 AND prediction = 'Yes') AS tp,
                           count(*) FILTER (actual_churn = 0 AND prediction = 'Yes') AS fp,
                           count(*) FILTER (actual_churn = 1 AND prediction = 'No') AS fn,
                           count(*) FILTER (actual_churn = 0 AND prediction = 'No') AS tn FROM cur) AS c
              CROSS JOIN (SELECT sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS area
                          FROM (SELECT *, sum(neg) OVER (ORDER BY churn_probability) - neg AS below
                                FROM (SELECT churn_probability, sum(actual_churn) AS pos, sum(1 - actual_churn) AS neg
                                      FROM cur GROUP BY 1) AS s) AS r) AS a) AS p
        UNION ALL
        SELECT 'run/ok', NULL, (SELECT count(*) > 0 FROM drift_rows WHERE is_drifted
                                AND NOT (drift_type = 'prediction' AND statistic_name = 'ks')), (SELECT count(*) FROM cur)""",
    "drift_matrix": """
        SELECT feature_name, arg_max(statistic_value, computed_at) FILTER (statistic_name = 'psi') AS psi,
               arg_max(statistic_value, computed_at) FILTER (statistic_name = 'ks') AS ks,
               arg_max(statistic_value, computed_at) FILTER (statistic_name = 'chi_square') AS chi_square
        FROM dm WHERE feature_name IS NOT NULL GROUP BY feature_name""",
    "latest_drift": """
        SELECT computed_at, coalesce(feature_name, '') AS feature_name, drift_type, statistic_name, statistic_value, threshold, is_drifted
        FROM dm ORDER BY computed_at DESC, coalesce(feature_name, '') DESC, statistic_name DESC LIMIT 20""",
    "latest_performance": """
        SELECT computed_at, sample_size, metric_name, metric_value FROM perf_rows
        WHERE computed_at = (SELECT max(computed_at) FROM perf)""",
    "alert_rules": "SELECT * FROM fired",
    "active_alerts": """
        SELECT computed_at AS fired_at, severity, category, message, metric_value, threshold, severity = 'info' AS acknowledged
        FROM fired WHERE severity <> 'info' ORDER BY computed_at DESC, message DESC LIMIT 50""",
    "latest_run": """
        SELECT c.day AS computed_at, n AS records_processed, drift_detected, 'ok' AS status
        FROM day_cells c JOIN (SELECT computed_at, bool_or(is_drifted) AS drift_detected FROM dm GROUP BY 1) d ON c.day = d.computed_at
        ORDER BY c.day DESC LIMIT 1""",
    "batch_summary": """
        SELECT count(*) AS consumed, count(*) FILTER (error IS NULL) AS predicted, count(*) FILTER (error IS NOT NULL) AS dead_lettered,
               round(100.0 * count(*) FILTER (label = 'Yes') / count(*) FILTER (error IS NULL), 2) AS overall_churn_pct,
               round(avg(p), 4) AS mean_churn_probability FROM routed""",
    "segment_rate_events": f"SELECT contract, count(*) AS total, {_RATE} AS churn_rate_pct FROM pred GROUP BY contract",
    "churn_rate_by_segment": f"SELECT contract, count(*) AS total, {_RATE} AS churn_rate_pct FROM latest GROUP BY contract",
    "prediction_volume": "SELECT strftime(processed_ts, '%Y-%m-%d %H:00') AS bucket, count(*) AS count FROM pred GROUP BY 1",
    "prediction_volume_daily": "SELECT strftime(processed_ts, '%Y-%m-%d') AS bucket, count(*) AS count FROM pred GROUP BY 1",
    "prediction_count": "SELECT count(*) AS n FROM events",
    "overview_kpis": f"""
        SELECT total, round(rate, 6) AS churn_rate_pct, round(avg, 6) AS avg_probability, high AS high_risk_count,
               CASE WHEN ptotal > 0 THEN total - ptotal END AS delta_total,
               round(CASE WHEN ptotal > 0 THEN rate - prate END, 6) AS delta_churn_rate_pct,
               round(CASE WHEN ptotal > 0 THEN avg - pavg END, 6) AS delta_avg_probability,
               CASE WHEN ptotal > 0 THEN high - phigh END AS delta_high_risk_count
        FROM (SELECT {_kpis("r <= 40", "")}, {_kpis("r > 40", "p")}
              FROM (SELECT *, row_number() OVER (ORDER BY processed_ts DESC, event_id DESC) AS r
                    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY processed_ts DESC, event_id DESC) AS q
                          FROM (SELECT * FROM pred ORDER BY processed_ts DESC, event_id DESC LIMIT 80)) WHERE q = 1))""",
    "score_batch_summary": """
        SELECT count(*) AS count, round(count(*) FILTER (prediction = 'Yes') / CAST(count(*) AS DOUBLE), 4) AS churn_rate,
               round(avg(churn_probability), 4) AS mean_probability FROM pred""",
    "probability_histogram": """
        SELECT b AS bin, round(b / 30.0, 6) AS low, round((b + 1) / 30.0, 6) AS high, coalesce(n, 0) AS count
        FROM (SELECT unnest(range(0, 30)) AS b) LEFT JOIN
             (SELECT least(CAST(floor(churn_probability * 30) AS BIGINT), 29) AS bin, count(*) AS n FROM pred GROUP BY 1) ON b = bin""",
    "current_model_version": """
        SELECT model_version, 'predictions' AS source FROM pred WHERE model_version IS NOT NULL
        ORDER BY processed_ts DESC, event_id DESC LIMIT 1""",
    "latest_per_customer": "SELECT customer_id, event_id, churn_probability, prediction FROM latest",
    "topk_events": """
        SELECT event_id, customer_id, churn_probability, prediction FROM pred ORDER BY churn_probability DESC, event_id LIMIT 10""",
    "topk_customers": """
        SELECT customer_id, churn_probability, contract,
               CASE WHEN churn_probability > 0.7 THEN 'high' WHEN churn_probability > 0.4 THEN 'medium' ELSE 'low' END AS risk
        FROM latest WHERE contract IN ('click', 'view', 'error') ORDER BY churn_probability DESC, customer_id LIMIT 10""",
    "recent_predictions": f"""
        SELECT event_id, customer_id, churn_probability, {_ISO.format("processed_ts")} AS processed_ts
        FROM (SELECT * FROM pred ORDER BY pred.processed_ts DESC, event_id DESC LIMIT 200)""",
    "upsert_new_rows": f"""
        SELECT event_id, customer_id, {_ISO.format("h")} AS processed_ts
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, h ORDER BY event_id DESC) AS r FROM up) u
        WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM up e WHERE e.processed_ts < TIMESTAMP '2024-01-16'
              AND e.customer_id = u.customer_id AND e.h IS NOT DISTINCT FROM u.h)""",
    "backfill_segment": """
        SELECT p.event_id, p.customer_id, CASE WHEN p.event_id % 4 = 0 THEN p.contract ELSE m.contract END AS contract
        FROM pred p LEFT JOIN (SELECT customer_id, arg_max(contract, event_id) AS contract FROM cur GROUP BY 1) m
        ON p.customer_id = m.customer_id""",
    "champion_selection": """
        SELECT b.version AS best_version, b.metric AS best_metric, c.version AS current_version, c.metric AS current_metric,
               b.metric > c.metric AS promote, CASE WHEN b.metric > c.metric THEN b.version ELSE c.version END AS new_production,
               CASE WHEN b.metric > c.metric THEN (SELECT max(version) FROM version_metrics) END AS new_staging,
               CASE WHEN b.metric > c.metric THEN 'promoted' ELSE 'best does not beat current production' END AS reason
        FROM (SELECT * FROM version_metrics ORDER BY metric DESC, version LIMIT 1) b
        CROSS JOIN (SELECT * FROM version_metrics ORDER BY version LIMIT 1) c""",
    "benchmark_pivot": """
        SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F_fit_s", count(*) FILTER (o_orderstatus = 'F') AS "F_n",
               round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O_fit_s", count(*) FILTER (o_orderstatus = 'O') AS "O_n",
               round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P_fit_s", count(*) FILTER (o_orderstatus = 'P') AS "P_n"
        FROM orders GROUP BY o_orderpriority""",
    "standardize": "SELECT * FROM z",
    "stream_route_events": f"""
        SELECT customer_id AS "customerID", p AS churn_probability, label AS prediction, {_ISO.format("ts")} AS event_ts,
               '2024-02-01T00:00:00Z' AS processed_ts, CASE WHEN actual_churn = 1 THEN 'Yes' ELSE 'No' END AS actual_churn,
               contract AS "Contract" FROM routed WHERE error IS NULL""",
    "stream_dead_letters": "SELECT error, count(*) AS n FROM routed WHERE error IS NOT NULL GROUP BY error",
    "stream_ingest": """
        SELECT prediction, count(*) AS n, count(*) FILTER (processed_ts IS NULL) AS n_no_time, round(sum(churn_probability), 4) AS sum_probability
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, processed_ts ORDER BY event_id DESC) AS r FROM messages
              WHERE customer_id IS NOT NULL AND churn_probability IS NOT NULL) WHERE r = 1 GROUP BY prediction""",
    "stream_publish": """
        SELECT CAST(user_id AS VARCHAR) AS key, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type
               || '","sent":"2024-02-01T00:00:00Z"}' AS value FROM events""",
    "stream_volume": f"""
        SELECT {_ISO.format("date_trunc('hour', ts)")} AS start, count(*) AS count FROM events GROUP BY 1""",
}

BODIES["stream_volume_closed"] = f"""
        SELECT {_ISO.format("date_trunc('hour', ts)")} AS start, count(*) AS count FROM events GROUP BY date_trunc('hour', ts)
        HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
BODIES["stream_observed"] = """
        SELECT count(*) AS consumed, count(*) FILTER (error IS NULL) AS predicted, count(*) FILTER (error IS NOT NULL) AS dead_lettered
        FROM routed"""
BODIES["stream_distinct"] = """
        SELECT min(event_id) AS event_id, user_id, event_type FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
                SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 6 HOUR
                               THEN 0 ELSE 1 END AS fresh FROM events))
        GROUP BY user_id, event_type, run HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)"""
BODIES["ordered_topic"] = """
        SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, CAST(0 AS BIGINT) AS n_out_of_order FROM events GROUP BY user_id"""
BODIES["external_scores"] = """
        SELECT event_id, round(1 / (1 + exp(-(0.03 * value - 0.02 * CASE WHEN k % 7 <> 0 THEN k ELSE 0 END))), 6) AS probability,
               'numpy' AS model_source, '1' AS model_version
        FROM (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)"""
BODIES["stream_late_rows"] = """
        WITH top AS (SELECT max(ts) FILTER (event_id % 3 = 0) AS a, max(ts) FILTER (event_id % 3 < 2) AS b, max(ts) AS c FROM events),
        split AS (SELECT event_id % 3 AS p, date_trunc('hour', ts) AS h,
                         date_trunc('hour', ts) + INTERVAL 1 HOUR <= CASE event_id % 3 WHEN 1 THEN a WHEN 2 THEN b END - INTERVAL 1 HOUR AS late
                  FROM events, top)
        SELECT 'late ' || p AS part, count(*) AS n FROM split WHERE late GROUP BY p
        UNION ALL
        SELECT 'closed hours ' || count(DISTINCT h), count(*) FROM split, top
        WHERE NOT coalesce(late, FALSE) AND h + INTERVAL 1 HOUR <= c - INTERVAL 1 HOUR"""
BODIES["performance_rows"] = """
        SELECT metric_name, round(v, 6) AS metric_value, n AS sample_size FROM (
        SELECT n, unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric_name,
               unnest([(tp + tn) / CAST(n AS DOUBLE), tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE),
                       2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)]) AS v
        FROM (SELECT CAST(sum(n) AS BIGINT) AS n, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM day_cells)
        UNION ALL
        SELECT (SELECT count(*) FROM pred), 'roc_auc', sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))
        FROM (SELECT *, sum(neg) OVER (ORDER BY churn_probability) - neg AS below
              FROM (SELECT churn_probability, sum(actual_churn) AS pos, sum(1 - actual_churn) AS neg FROM pred GROUP BY 1)))"""
BODIES["dead_letters"] = """
        SELECT event_id, CASE WHEN readable THEN customer_id ELSE 'unknown' END AS key, error, '2024-02-01T00:00:00Z' AS failed_ts
        FROM routed WHERE error IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in BODIES.items()}
