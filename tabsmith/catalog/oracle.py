"""The registered queries in SQL, written from the definitions of the operators."""

from __future__ import annotations

from tabsmith.catalog.tables import DIRTY, DOUBLED, EVENTS, FLAGGED, LABELLED, SCORED

LINE_NUM = ["orderkey", "partkey", "suppkey", "linenumber", "quantity", "price", "discount", "tax"]
LINE_TEXT = ["returnflag", "linestatus"]
LINE_ALL = LINE_NUM + LINE_TEXT
EV_ALL = ["event_id", "user_id", "event_type", "value", "balance", "props", "channel", "nothing"]
EV_NUM = ["event_id", "user_id", "value", "balance", "nothing"]
EV_TEXT = ["event_type", "props", "channel"]


def r(x: str, places: int) -> str:
    """Half-up rounding of the decimal text of a double, as Spark rounds."""
    return f"CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(36, 16)), {places}) AS DOUBLE)"


def big(x: str, places: int = 4) -> str:
    return f"CASE WHEN abs({x}) >= 1e6 THEN round({x}, 0) ELSE {r(f'CASE WHEN abs({x}) < 1e6 THEN {x} END', places)} END"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def stats(table: str, order: list[str], numeric: list[str], text: list[str]) -> str:
    """CTE `st`: one row per column with the statistics of the operators."""
    parts = []
    for c in order:
        pos = order.index(c)
        base = f"SELECT '{c}' AS column_name, {pos} AS position, count(*) AS n, count({c}) AS nn, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS uniq"
        if c in numeric:
            x = f"CAST({c} AS DOUBLE)"
            parts.append(
                f"{base}, TRUE AS is_num, min({x}) AS mn, max({x}) AS mx, avg({x}) AS mean, coalesce(stddev_samp({x}), 0) AS sd,"
                f" coalesce(var_samp({x}), 0) AS var, coalesce(skewness({x}), 0) AS skew, quantile_cont({x}, 0.25) AS q1,"
                f" quantile_cont({x}, 0.5) AS med, quantile_cont({x}, 0.75) AS q3 FROM {table}"
            )
        else:
            nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {k}" for k in ("mn", "mx", "mean", "sd", "var", "skew", "q1", "med", "q3"))
            parts.append(f"{base}, FALSE AS is_num, {nulls} FROM {table}")
    outliers = union(
        [
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers"
            f" FROM {table} CROSS JOIN (SELECT q1, q3 FROM base WHERE column_name = '{c}')"
            for c in numeric
        ]
    )
    tops = union(
        [
            f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS top_value, count(*) AS top_count FROM {table}"
            f" WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
            for c in order
        ]
    )
    return (
        f"base AS ({union(parts)}),\nouts AS ({outliers}),\ntops AS ({tops}),\n"
        "st AS (SELECT b.*, coalesce(o.outliers, 0) AS outliers, t.top_value, coalesce(t.top_count, 0) AS top_count"
        " FROM base b LEFT JOIN outs o USING (column_name) LEFT JOIN tops t USING (column_name))"
    )


LINE = f"WITH {DIRTY},\n{stats('dirty', LINE_ALL, LINE_NUM, LINE_TEXT)}\n"
DOUBLE = f"WITH {DOUBLED},\n{stats('doubled', LINE_ALL, LINE_NUM, LINE_TEXT)}\n"
EV = f"WITH {EVENTS},\n{stats('ev', EV_ALL, EV_NUM, EV_TEXT)}\n"
CUST_ALL = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUST = f"WITH {stats('customer', CUST_ALL, ['c_custkey', 'c_nationkey', 'c_acctbal'], ['c_name', 'c_mktsegment'])}\n"

KIND = "CASE WHEN is_num THEN 'numeric' ELSE 'categorical/text' END"
PCT = "CAST({0} AS DOUBLE) / n * 100"
HIGH = "(NOT is_num AND (uniq > 25 OR (CAST(uniq AS DOUBLE) / n > 0.5 AND n > 10)))"
SHARE_OUT = "CAST(outliers AS DOUBLE) / n * 100"

FLAGS = f"""concat_ws('|',
 CASE WHEN missing = n THEN 'completely missing' WHEN 100.0 * missing / n > 20 THEN 'high missingness' END,
 CASE WHEN NOT is_num AND uniq <= 10 THEN 'low cardinality' END,
 CASE WHEN NOT is_num AND uniq > n * 0.5 AND n > 10 THEN 'high cardinality' END,
 CASE WHEN NOT is_num AND (uniq = n OR (CAST(uniq AS DOUBLE) / n > 0.99 AND n > 1)) THEN 'potential identifier' END,
 CASE WHEN is_num AND nn > 0 AND abs({r('skew', 4)}) > 1 THEN 'highly skewed' END,
 CASE WHEN is_num AND {r(SHARE_OUT, 2)} > 5 THEN 'outlier-heavy' END,
 CASE WHEN uniq <= 1 OR 100.0 * top_count / n >= 95 THEN 'constant/near-constant' END)"""

# Rules of the decision plan over `st`.
STATUS = """CASE WHEN nn = 0 THEN 'completely_missing' WHEN uniq <= 1 THEN 'constant'
 WHEN NOT is_num AND uniq = n AND n > 1 THEN 'potential_identifier'
 WHEN is_num THEN 'usable_numeric' ELSE 'usable_categorical' END"""
STATUS_RULE = """CASE WHEN nn = 0 THEN 'RULE_COMPLETELY_MISSING_EXCLUSION' WHEN uniq <= 1 THEN 'RULE_CONSTANT_COLUMN_EXCLUSION'
 WHEN NOT is_num AND uniq = n AND n > 1 THEN 'RULE_HIGH_CARDINALITY_IDENTIFIER_EXCLUSION'
 WHEN is_num THEN 'RULE_USABLE_NUMERIC_RETAIN' ELSE 'RULE_USABLE_CATEGORICAL_RETAIN' END"""
PLAN = EV + f""", plan AS (SELECT *, {STATUS} AS status, {STATUS_RULE} AS status_rule FROM st),
steps AS (
SELECT column_name, 0 AS step, 'column_evaluation' AS stage, status_rule AS rule_id,
 CASE WHEN status LIKE 'usable%' THEN 'retain' ELSE 'exclude' END AS selected_action FROM plan
UNION ALL
SELECT column_name, 1, 'imputation',
 CASE WHEN missing = 0 THEN 'RULE_IMPUTATION_NONE' WHEN NOT is_num THEN 'RULE_CATEGORICAL_IMPUTATION_MODE'
 WHEN abs(skew) < 1 THEN 'RULE_SKEW_AWARE_IMPUTATION_MEAN' ELSE 'RULE_SKEW_AWARE_IMPUTATION_MEDIAN' END,
 CASE WHEN missing = 0 THEN 'none' WHEN NOT is_num THEN 'most_frequent_imputation'
 WHEN abs(skew) < 1 THEN 'mean_imputation' ELSE 'median_imputation' END FROM plan WHERE status LIKE 'usable%'
UNION ALL
SELECT column_name, 2, 'log_transformation',
 CASE WHEN abs(skew) > 1 AND mn >= 0 THEN 'RULE_LOG1P_TRANSFORM_APPLY' WHEN abs(skew) > 1 THEN 'RULE_LOG1P_TRANSFORM_NEGATIVE_BLOCK'
 ELSE 'RULE_LOG1P_TRANSFORM_NOT_NEEDED' END,
 CASE WHEN abs(skew) > 1 AND mn >= 0 THEN 'log1p_transformation' ELSE 'none' END FROM plan WHERE status = 'usable_numeric'
UNION ALL
SELECT column_name, 3, 'scaling',
 CASE WHEN CAST(outliers AS DOUBLE) / n > 0.02 THEN 'RULE_OUTLIER_AWARE_SCALING_ROBUST' ELSE 'RULE_OUTLIER_AWARE_SCALING_STANDARD' END,
 CASE WHEN CAST(outliers AS DOUBLE) / n > 0.02 THEN 'RobustScaler' ELSE 'StandardScaler' END FROM plan WHERE status = 'usable_numeric'
UNION ALL
SELECT column_name, 2, 'encoding',
 CASE WHEN uniq <= 15 THEN 'RULE_CARDINALITY_ENCODING_ONEHOT' ELSE 'RULE_CARDINALITY_ENCODING_ORDINAL' END,
 CASE WHEN uniq <= 15 THEN 'one_hot_encoding' ELSE 'label_encoding' END FROM plan WHERE status = 'usable_categorical')
"""


def stage(name: str) -> str:
    return PLAN + f"SELECT column_name, rule_id, selected_action FROM steps WHERE stage = '{name}'"


def pairs(table: str, columns: list[str]) -> str:
    """CTE `prs`: correlations of all column pairs in order."""
    out = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            out.append(f"SELECT {i} AS p1, '{a}' AS column_1, {j} AS p2, '{b}' AS column_2, {r(f'corr({a}, {b})', 4)} AS correlation FROM {table}")
    return f"prs AS ({union(out)})"


def histogram(table: str, columns: list[str], bins: int = 10) -> str:
    out = []
    for c in columns:
        out.append(f"""SELECT '{c}' AS column_name, CAST(g.bin AS INTEGER) AS bin,
 {r(f'lo + (hi - lo) / {bins} * g.bin', 2)} AS bin_start,
 {r(f'CASE WHEN g.bin = {bins - 1} THEN hi ELSE lo + (hi - lo) / {bins} * (g.bin + 1) END', 2)} AS bin_end,
 coalesce(cnt, 0) AS bin_count
FROM (SELECT unnest(range({bins})) AS bin) g CROSS JOIN (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM {table}) e
LEFT JOIN (SELECT least(floor(({c} - lo) * {bins}.0 / (hi - lo)), {bins - 1}) AS b, count(*) AS cnt FROM {table}
 CROSS JOIN (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM {table}) WHERE {c} IS NOT NULL GROUP BY 1) h ON h.b = g.bin""")
    return union(out)


def boxplots(columns: list[str]) -> str:
    out = []
    for c in columns:
        out.append(f"""SELECT column_name, {r('mn', 4)} AS min, {r('q1', 4)} AS q1, {r('med', 4)} AS median, {r('q3', 4)} AS q3, {r('mx', 4)} AS max,
 coalesce((SELECT string_agg(printf('%.2f', {r('v', 2)}), ',' ORDER BY event_id) FROM (SELECT event_id, CAST({c} AS DOUBLE) AS v FROM ev
 CROSS JOIN (SELECT q1 AS a, q3 AS b FROM st WHERE column_name = '{c}')
 WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) ORDER BY event_id LIMIT 10)), '') AS outliers_sample
FROM st WHERE column_name = '{c}'""")
    return EV + union(out)


def standard(c: str, places: int = 4) -> str:
    """Mean-imputed and standardised column over the whole table."""
    filled = f"coalesce({c}, avg({c}) OVER ())"
    return r(f"({filled} - avg({c}) OVER ()) / sqrt(var_pop({c}) OVER () * count({c}) OVER () / count(*) OVER ())", places)


TARGET_SCORES = f"""WITH {LABELLED},
vals AS (SELECT 0 AS position, 'doc_id' AS column_name, CAST(doc_id AS VARCHAR) AS v, TRUE AS is_num FROM docs
UNION ALL SELECT 1, 'lang', lang, FALSE FROM docs UNION ALL SELECT 2, 'source', source, FALSE FROM docs
UNION ALL SELECT 3, 'n_chars', CAST(n_chars AS VARCHAR), TRUE FROM docs
UNION ALL SELECT 4, 'quality', CAST(quality AS VARCHAR), TRUE FROM docs UNION ALL SELECT 5, 'toxic', CAST(toxic AS VARCHAR), TRUE FROM docs),
freq AS (SELECT position, column_name, is_num, v, count(*) AS cnt FROM vals WHERE v IS NOT NULL GROUP BY ALL),
agg AS (SELECT position, column_name, is_num, count(*) AS uniq, min(cnt) / CAST(sum(cnt) AS DOUBLE) AS share, bool_and(v IN ('0', '1')) AS bin FROM freq GROUP BY ALL),
scored AS (SELECT *, CASE WHEN uniq = 2 THEN 55 WHEN uniq BETWEEN 3 AND 6 THEN 35 WHEN uniq BETWEEN 7 AND 15 AND NOT is_num THEN 15 END
 + CASE WHEN share >= 0.05 THEN 15 WHEN share >= 0.01 THEN 5 ELSE -10 END + CASE WHEN position = 5 THEN 10 ELSE 0 END
 + CASE WHEN uniq = 2 AND bin THEN 15 ELSE 0 END AS score
 FROM agg CROSS JOIN (SELECT count(*) AS n FROM docs)
 WHERE uniq > 1 AND NOT (column_name = 'doc_id' AND (uniq / CAST(n AS DOUBLE) > 0.3 OR uniq > 100)) AND NOT (uniq / CAST(n AS DOUBLE) > 0.8 AND n > 20))
SELECT CAST(row_number() OVER (ORDER BY score DESC, position) AS INTEGER) AS rank, column_name, CAST(score AS DOUBLE) AS score,
 uniq AS unique_count, {r('share', 6)} AS min_class_share FROM scored WHERE score IS NOT NULL"""


def purity_sql(columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS column_name, {r('avg(share)', 6)} AS purity, count(*) AS categories FROM (SELECT v, max(cnt) / CAST(sum(cnt) AS DOUBLE) AS share"
            f" FROM (SELECT {c} AS v, flag, count(*) AS cnt FROM flagged GROUP BY ALL) GROUP BY v)"
            for c in columns
        ]
    )


def clean_doubled() -> str:
    fills = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT CASE WHEN abs(skew) < 1 THEN mean ELSE med END FROM st WHERE column_name = '{c}')) AS {c}" for c in LINE_NUM)
    modes = ", ".join(f"coalesce({c}, (SELECT top_value FROM st WHERE column_name = '{c}')) AS {c}" for c in LINE_TEXT)
    return f"clean AS (SELECT {fills}, {modes} FROM doubled)"


def side_stats(table: str, prefix: str) -> str:
    parts = []
    for c in LINE_NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS missing, min({x}) AS mn, max({x}) AS mx, avg({x}) AS mean,"
            f" stddev_samp({x}) AS sd, skewness({x}) AS skew, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med, quantile_cont({x}, 0.75) AS q3 FROM {table}"
        )
    outs = union(
        [
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS outliers"
            f" FROM {table} CROSS JOIN (SELECT q1, q3 FROM {prefix}0 WHERE column_name = '{c}')"
            for c in LINE_NUM
        ]
    )
    return f"{prefix}0 AS ({union(parts)}), {prefix}1 AS ({outs}), {prefix} AS (SELECT * FROM {prefix}0 JOIN {prefix}1 USING (column_name))"


COMPARE = DOUBLE + ", " + clean_doubled() + ",\n" + side_stats("doubled", "bf") + ",\n" + side_stats("clean", "af") + "\n"


def missing_cells(table: str) -> str:
    return " + ".join(f"(count(*) - count({c}))" for c in LINE_ALL) + f" FROM {table}"


def dup(table: str) -> str:
    return f"(SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM {table} GROUP BY {', '.join(LINE_ALL)}))"


def compare_hist() -> str:
    out = []
    for c in LINE_NUM:
        rng = f"(SELECT least(b.mn, a.mn) AS lo, greatest(b.mx, a.mx) AS hi FROM bf b JOIN af a USING (column_name) WHERE column_name = '{c}')"
        cnt = lambda t: f"(SELECT least(floor(({c} - lo) * 10.0 / (hi - lo)), 9) AS b, count(*) AS cnt FROM {t} CROSS JOIN {rng} WHERE {c} IS NOT NULL GROUP BY 1)"
        out.append(f"""SELECT '{c}' AS column_name, CAST(g.bin AS INTEGER) AS bin, {r('lo + (hi - lo) / 10 * g.bin', 2)} AS bin_start,
 {r('CASE WHEN g.bin = 9 THEN hi ELSE lo + (hi - lo) / 10 * (g.bin + 1) END', 2)} AS bin_end,
 coalesce(x.cnt, 0) AS before_count, coalesce(y.cnt, 0) AS after_count
FROM (SELECT unnest(range(10)) AS bin) g CROSS JOIN {rng} e LEFT JOIN {cnt('doubled')} x ON x.b = g.bin LEFT JOIN {cnt('clean')} y ON y.b = g.bin""")
    return COMPARE + union(out)


def compare_categories() -> str:
    out = []
    for c in LINE_TEXT:
        out.append(f"""SELECT '{c}' AS column_name, CAST(rn AS INTEGER) AS rank, v AS category, before_count, coalesce(after_count, 0) AS after_count FROM
 (SELECT coalesce({c}, '(Missing)') AS v, count(*) AS before_count, row_number() OVER (ORDER BY count(*) DESC, coalesce({c}, '(Missing)')) AS rn FROM doubled GROUP BY 1)
 LEFT JOIN (SELECT coalesce({c}, '(Missing)') AS v, count(*) AS after_count FROM clean GROUP BY 1) USING (v) WHERE rn <= 8""")
    return COMPARE + union(out)


def compare_long_text() -> str:
    out = []
    for c in ("text", "lang", "source"):
        out.append(f"""SELECT '{c}' AS column_name, CAST(rn AS INTEGER) AS rank, v AS category, before_count, coalesce(after_count, 0) AS after_count FROM
 (SELECT coalesce({c}, '(Missing)') AS v, count(*) AS before_count, row_number() OVER (ORDER BY count(*) DESC, coalesce({c}, '(Missing)')) AS rn FROM documents GROUP BY 1)
 LEFT JOIN (SELECT coalesce({c}, (SELECT {c} FROM documents WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS v, count(*) AS after_count
  FROM documents GROUP BY 1) USING (v) WHERE rn <= 8""")
    return union(out)


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} IS NULL OR {den} = 0 THEN 0.0 ELSE {num} / {den} END"


def anova_sql(columns: list[str], target: str, fill: bool = True) -> str:
    """F statistic per column from the sums of squares between and within classes."""
    out = []
    for c in columns:
        x = f"coalesce({c}, 0.0)"
        out.append(f"""SELECT '{c}' AS feature, (sum(k * (m - g) * (m - g)) / (count(*) - 1)) / (sum(k * v) / (sum(k) - count(*))) AS f
 FROM (SELECT {target}, count(*) AS k, avg({x}) AS m, var_pop({x}) AS v FROM src WHERE {target} IS NOT NULL GROUP BY {target})
 CROSS JOIN (SELECT avg({x}) AS g FROM src WHERE {target} IS NOT NULL)""")
    return union(out)


SELECTOR = f"""WITH {DIRTY}, src AS (SELECT quantity, price, discount, tax, discount * 0.001 AS tiny, quantity * 3 + 1 AS tripled,
 price / 2 + tax AS half_price, linestatus FROM dirty)
"""

REPORT = f"""WITH {SCORED}, per AS (SELECT class, sum(support) AS support, sum(chosen) AS chosen, sum(hits) AS hits FROM (
 SELECT flag AS class, 1 AS support, 0 AS chosen, CAST(flag = flag_predicted AS INTEGER) AS hits FROM scored
 UNION ALL SELECT flag_predicted, 0, 1, 0 FROM scored) GROUP BY class),
pr AS (SELECT class, support, hits, CASE WHEN chosen = 0 THEN 0 ELSE hits / CAST(chosen AS DOUBLE) END AS p,
 CASE WHEN support = 0 THEN 0 ELSE hits / CAST(support AS DOUBLE) END AS rc FROM per),
f AS (SELECT *, CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END AS f1 FROM pr)
"""


def auc(condition: str, score: str) -> str:
    """Rank-sum area over the scored rows, ties counted half."""
    return f"""(SELECT (sum(CASE WHEN y THEN rk END) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0)
 / (CAST(count(*) FILTER (WHERE y) AS DOUBLE) * count(*) FILTER (WHERE NOT y)) FROM
 (SELECT y, (first_rank + (first_rank + same - 1)) / 2.0 AS rk FROM
 (SELECT {condition} AS y, rank() OVER (ORDER BY {score}) AS first_rank, count(*) OVER (PARTITION BY {score}) AS same FROM scored)))"""


BINARY = f"""WITH {SCORED},
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE truth = 1 AND predicted = 1) AS DOUBLE) AS tp,
 CAST(count(*) FILTER (WHERE truth = 0 AND predicted = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE truth = 1 AND predicted = 0) AS DOUBLE) AS fn,
 CAST(count(*) FILTER (WHERE truth = 0 AND predicted = 0) AS DOUBLE) AS tn FROM scored),
k AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, (tp + fn) / n AS w1, (tn + fp) / n AS w0 FROM m),
f AS (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1_1, 2 * p0 * r0 / (p0 + r0) AS f1_0 FROM k)
SELECT {r('(tp + tn) / n', 4)} AS accuracy, {r('p1', 4)} AS precision, {r('r1', 4)} AS recall, {r('f1_1', 4)} AS f1,
 {r('(p1 + p0) / 2', 4)} AS precision_macro, {r('(r1 + r0) / 2', 4)} AS recall_macro, {r('(f1_1 + f1_0) / 2', 4)} AS f1_macro,
 {r('p1 * w1 + p0 * w0', 4)} AS precision_weighted, {r('r1 * w1 + r0 * w0', 4)} AS recall_weighted, {r('f1_1 * w1 + f1_0 * w0', 4)} AS f1_weighted,
 {r(auc('truth = 1', 'score'), 4)} AS roc_auc FROM f"""


def findings_rows() -> str:
    nums = [c for c in EV_NUM if c != "nothing"]
    return EV + f""", {pairs('ev', nums)},
total AS (SELECT sum(missing) AS m, CAST(sum(missing) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100 AS p FROM st),
miss AS (SELECT *, row_number() OVER (ORDER BY missing DESC, position) AS rn, {r(PCT.format('missing'), 2)} AS p FROM st WHERE missing > 0),
outl AS (SELECT *, row_number() OVER (ORDER BY outliers DESC, position) AS rn, {r(SHARE_OUT, 2)} AS p FROM st WHERE outliers > 0),
strong AS (SELECT *, row_number() OVER (ORDER BY abs(correlation) DESC, p1, p2) AS rn FROM prs WHERE abs(correlation) >= 0.7),
finds AS (
SELECT 0 AS section, 0 AS ord, 'Missingness' AS category, CASE WHEN m = 0 THEN 'info' WHEN {r('p', 2)} > 15 THEN 'high' ELSE 'medium' END AS severity,
 m || ' missing values in the table (' || {r('p', 2)} || '%)' AS message FROM total
UNION ALL SELECT 1, rn, 'Missingness', CASE WHEN p > 50 THEN 'high' WHEN p > 10 THEN 'medium' ELSE 'low' END, '''' || column_name || ''' misses ' || p || '% of its values' FROM miss WHERE rn <= 5
UNION ALL SELECT 2, position, 'Distribution / Skewness', 'medium', '''' || column_name || ''' is skewed to the ' || CASE WHEN skew > 0 THEN 'right' ELSE 'left' END || ' (skewness ' || {r('skew', 4)} || ')' FROM st WHERE is_num AND nn > 0 AND abs({r('skew', 4)}) > 1
UNION ALL SELECT 3, rn, 'Outliers', CASE WHEN p > 5 THEN 'medium' ELSE 'low' END, '''' || column_name || ''' has ' || outliers || ' outliers (' || p || '% of rows)' FROM outl WHERE rn <= 5 AND p > 2
UNION ALL SELECT 4, rn, 'Correlation', CASE WHEN abs(correlation) < 0.9 THEN 'info' ELSE 'medium' END, '''' || column_1 || ''' and ''' || column_2 || ''' move together (r = ' || correlation || ')' FROM strong WHERE rn <= 5
UNION ALL SELECT 5, position, 'Cardinality', 'info', '''' || column_name || ''' has ' || uniq || ' different values' FROM st WHERE {HIGH})
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["dataset_summary"] = f"""WITH {DOUBLED} SELECT count(*) AS num_rows, 10 AS num_cols, 8 AS numeric_column_count, 2 AS categorical_column_count,
 any_value(d) AS duplicate_row_count, {" + ".join(f"(count(*) - count({c}))" for c in LINE_ALL)} AS missing_value_count,
 {r("CAST(" + " + ".join(f"(count(*) - count({c}))" for c in LINE_ALL) + " AS DOUBLE) / (count(*) * 10) * 100", 2)} AS missing_value_percentage
 FROM doubled CROSS JOIN (SELECT CAST({dup('doubled')} AS BIGINT) AS d)"""
    q["duplicate_rows"] = f"WITH {DOUBLED} SELECT CAST({dup('doubled')} AS BIGINT) AS duplicate_row_count"
    part = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    q["data_size"] = "SELECT CAST(sum(" + " + ".join(f"strlen(CAST({c} AS VARCHAR))" for c in part) + ") AS BIGINT) AS data_bytes FROM part"
    q["column_missing"] = LINE + f"SELECT column_name, missing AS missing_count, {r(PCT.format('missing'), 2)} AS missing_percentage FROM st"
    q["column_distinct"] = LINE + f"SELECT column_name, uniq AS unique_count, {r('CAST(uniq AS DOUBLE) / n', 4)} AS cardinality FROM st"
    q["numeric_moments"] = LINE + "SELECT column_name, " + ", ".join(
        f"{big(a)} AS {b}" for a, b in (("mn", "min"), ("mx", "max"), ("mean", "mean"), ("sd", "std"), ("var", "variance"), ("skew", "skewness"))
    ) + " FROM st WHERE is_num"
    q["quartiles_iqr"] = EV + f"SELECT column_name, {r('q1', 4)} AS q1, {r('med', 4)} AS median, {r('q3', 4)} AS q3, {r('q3 - q1', 4)} AS iqr FROM st WHERE is_num"
    q["iqr_outliers"] = EV + f"SELECT column_name, outliers AS outlier_count, {r(SHARE_OUT, 2)} AS outlier_percentage FROM st WHERE is_num"
    q["most_frequent"] = EV + f"""SELECT column_name, top_value AS most_frequent_value, top_count AS most_frequent_frequency,
 {r(PCT.format('top_count'), 2)} AS most_frequent_percentage FROM st WHERE NOT is_num"""
    q["long_text_profile"] = union(
        [
            f"SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM documents) AS unique_count, v AS top_value, k AS top_count"
            f" FROM (SELECT {c} AS v, count(*) AS k FROM documents GROUP BY {c} ORDER BY k DESC, v LIMIT 1)"
            for c in ("text", "lang", "source")
        ]
    )
    q["quality_flags"] = EV + f"SELECT column_name, {FLAGS} AS flags FROM st"
    q["column_profile"] = CUST + f"""SELECT column_name, {KIND} AS inferred_type, missing AS missing_count, uniq AS unique_count,
 {r('CAST(uniq AS DOUBLE) / n', 4)} AS cardinality, {", ".join(f"{big(a)} AS {b}" for a, b in (("mn", "min"), ("mx", "max"), ("mean", "mean"), ("med", "median"), ("sd", "std"), ("var", "variance"), ("skew", "skewness"), ("q1", "q1"), ("q3", "q3"), ("q3 - q1", "iqr")))},
 CASE WHEN is_num THEN outliers END AS outlier_count, CASE WHEN NOT is_num THEN top_value END AS most_frequent_value,
 CASE WHEN NOT is_num THEN top_count END AS most_frequent_frequency FROM st"""
    q["target_profile"] = f"""WITH {DIRTY} SELECT returnflag AS class, count(*) AS class_count,
 {r("count(*) / (SELECT CAST(count(returnflag) AS DOUBLE) FROM dirty) * 100", 2)} AS class_percentage FROM dirty GROUP BY returnflag"""
    q["quality_score"] = DOUBLE + f""", parts AS (SELECT
 CAST(least(25, floor({r("CAST((SELECT sum(missing) FROM st) AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM st) * 100", 2)} * 2.5 + 0.5)) AS BIGINT) AS missing_deduction,
 CAST(CASE WHEN {dup('doubled')} > 0 THEN 10 ELSE 0 END AS BIGINT) AS duplicate_deduction,
 CAST(least(15, 2 * (SELECT count(*) FROM st WHERE is_num AND {r(SHARE_OUT, 2)} > 5)) AS BIGINT) AS outlier_deduction,
 CAST((SELECT CASE WHEN min(p) < 15 THEN 10 WHEN min(p) < 30 THEN 5 ELSE 0 END FROM (SELECT 100.0 * count(*) / (SELECT count(returnflag) FROM doubled) AS p FROM doubled GROUP BY returnflag)) AS BIGINT) AS imbalance_deduction),
total AS (SELECT *, greatest(10, 100 - missing_deduction - duplicate_deduction - outlier_deduction - imbalance_deduction) AS quality_score FROM parts)
SELECT *, CASE WHEN quality_score >= 85 THEN 'excellent' WHEN quality_score >= 70 THEN 'good' WHEN quality_score >= 50 THEN 'moderate' ELSE 'poor' END AS verdict FROM total"""
    q["missing_ranking"] = EV + f"""SELECT CAST(row_number() OVER (ORDER BY missing DESC, position) AS INTEGER) AS rank, column_name, missing AS missing_count,
 {r(PCT.format('missing'), 2)} AS missing_percentage FROM st WHERE missing > 0"""
    q["missing_overview"] = EV + f"""SELECT sum(missing) > 0 AS has_missing_values, CAST(sum(missing) AS BIGINT) AS total_missing_values,
 {r("CAST(sum(missing) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100", 2)} AS overall_missing_percentage FROM st"""
    q["numeric_summary"] = EV + f"""SELECT CAST(row_number() OVER (ORDER BY abs(skew) + {SHARE_OUT} / 10 DESC, position) AS INTEGER) AS interest_rank, column_name, nn AS count,
 {big('mean')} AS mean, {big('sd')} AS std, {big('var')} AS variance, {big('skew')} AS skewness, outliers AS outlier_count,
 {r(f'abs(skew) + {SHARE_OUT} / 10', 4)} AS interest_score FROM st WHERE is_num AND nn > 0"""
    q["histogram_10"] = f"WITH {EVENTS} " + histogram("ev", ["value", "balance", "user_id"])
    q["boxplot"] = boxplots(["value", "balance", "user_id"])
    q["categorical_summary"] = EV + f"""SELECT column_name, uniq AS unique_count, {r('CAST(uniq AS DOUBLE) / n', 4)} AS cardinality, missing AS missing_count,
 top_value AS most_frequent_value, top_count AS most_frequent_frequency, {r(PCT.format('top_count'), 2)} AS most_frequent_percentage, {HIGH} AS is_high_cardinality
 FROM st WHERE NOT is_num"""
    q["category_topk"] = union(
        [
            f"SELECT '{c}' AS column_name, CAST(rn AS INTEGER) AS rank, v AS category, k AS category_count, {r('k / (SELECT CAST(count(*) AS DOUBLE) FROM part) * 100', 2)} AS percentage"
            f" FROM (SELECT {c} AS v, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn FROM part GROUP BY {c}) WHERE rn <= 10"
            for c in ("p_brand", "p_type")
        ]
    )
    q["corr_pairs"] = f"WITH {DIRTY}, {pairs('dirty', LINE_NUM[1:])} SELECT column_1, column_2, correlation FROM prs"
    pn = ["p_partkey", "p_size", "p_retailprice"]
    q["corr_matrix"] = f"WITH {pairs('part', pn)} SELECT column_1, column_2, correlation FROM prs UNION ALL SELECT column_2, column_1, correlation FROM prs UNION ALL " + union(
        [f"SELECT '{c}', '{c}', 1.0" for c in pn]
    )
    q["corr_strong_pairs"] = f"""WITH {FLAGGED}, {pairs('flagged', ['quantity', 'discount', 'rebate', 'tax', 'flag'])}
SELECT CAST(row_number() OVER (ORDER BY abs(correlation) DESC, p1, p2) AS INTEGER) AS rank, column_1, column_2, correlation, abs(correlation) AS abs_correlation
FROM prs WHERE abs(correlation) >= 0.7"""
    q["outlier_table"] = EV + f"""SELECT CAST(row_number() OVER (ORDER BY outliers DESC, position) AS INTEGER) AS rank, column_name, outliers AS outlier_count,
 {r(SHARE_OUT, 2)} AS outlier_percentage, {r('q1 - 1.5 * (q3 - q1)', 4)} AS lower_bound, {r('q3 + 1.5 * (q3 - q1)', 4)} AS upper_bound,
 {r('mn', 4)} AS min, {r('mx', 4)} AS max, {r('q1', 4)} AS q1, {r('med', 4)} AS median, {r('q3', 4)} AS q3, {r('q3 - q1', 4)} AS iqr FROM st WHERE is_num AND outliers > 0"""
    q["findings"] = findings_rows() + "SELECT CAST(section AS INTEGER) AS section, CAST(ord AS BIGINT) AS ord, category, severity, message FROM finds"
    q["severity_counts"] = findings_rows() + "SELECT severity, count(*) AS findings FROM finds GROUP BY severity"
    q["top_findings"] = findings_rows() + """SELECT CAST(section AS INTEGER) AS section, category, severity FROM finds
 ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, section, ord LIMIT 5"""
    q["eda_flags"] = f"""WITH {DIRTY} SELECT TRUE AS missing_analysis, {" + ".join(f"(count(*) - count({c}))" for c in LINE_ALL)} > 0 AS missing_charts,
 TRUE AS numeric_analysis, TRUE AS categorical_analysis, TRUE AS correlation_analysis, TRUE AS outlier_analysis FROM dirty"""
    q["target_scores"] = TARGET_SCORES
    q["leak_correlation"] = f"WITH {FLAGGED} " + union(
        [f"SELECT '{c}' AS column_name, {r(f'abs(corr({c}, flag))', 6)} AS abs_r FROM flagged" for c in ("quantity", "discount", "rebate", "tax")]
    )
    q["leak_contingency"] = f"WITH {FLAGGED} " + union(
        [f"SELECT '{c}' AS column_name, {c} AS value, CAST(CAST(flag AS DOUBLE) AS VARCHAR) AS y, count(*) AS cnt FROM flagged GROUP BY {c}, flag" for c in ("returnflag", "band", "actual_status")]
    )
    q["leak_purity"] = f"WITH {FLAGGED} " + purity_sql(["returnflag", "band", "discount", "tax"])
    q["leakage"] = f"""WITH {FLAGGED}, pure AS ({purity_sql(["quantity", "discount", "tax", "returnflag", "band", "actual_status"])}),
cor AS ({union([f"SELECT '{c}' AS column_name, abs(corr({c}, flag)) AS r FROM flagged" for c in ("quantity", "discount", "rebate", "tax")])}),
found AS (SELECT column_name, 'high_correlation' AS type, 'high' AS severity, r AS statistic, printf('Its correlation with the target is %.4f.', r) AS reason FROM cor WHERE r >= 0.9
UNION ALL SELECT column_name, 'categorical_proxy', 'high', purity, printf('Within its values, %.2f %% of the rows share one class on average.', 100 * purity) FROM pure LEFT JOIN cor USING (column_name)
 WHERE coalesce(r, 0) < 0.9 AND purity >= 0.98 AND categories BETWEEN 2 AND 20
UNION ALL SELECT column_name, 'post_event_semantic', 'medium', NULL, 'Its name points to something that is recorded after the event.' FROM pure WHERE column_name = 'actual_status' AND NOT (purity >= 0.98 AND categories BETWEEN 2 AND 20))
SELECT column_name, type, severity, {r('statistic', 6)} AS statistic, reason,
 CASE severity WHEN 'high' THEN 'Leave it out of the predictors after a look at it; profiling keeps it.' ELSE 'Look at it before it becomes a predictor.' END AS recommendation FROM found"""
    q["plan_status"] = PLAN + "SELECT column_name, status, status LIKE 'usable%' AS is_usable, missing AS missing_count FROM plan"
    q["plan_imputation"] = stage("imputation")
    q["plan_scaling"] = stage("scaling")
    q["plan_log1p"] = stage("log_transformation")
    q["plan_encoding"] = stage("encoding")
    q["plan_trace"] = PLAN + "SELECT column_name, CAST(step AS INTEGER) AS step, stage, rule_id, selected_action FROM steps"
    acts = {"mean_imputations": "mean_imputation", "median_imputations": "median_imputation", "most_frequent_imputations": "most_frequent_imputation",
            "robust_scalers": "RobustScaler", "standard_scalers": "StandardScaler", "log1p_transformations": "log1p_transformation",
            "one_hot_encodings": "one_hot_encoding", "label_encodings": "label_encoding"}
    q["plan_count"] = PLAN + "SELECT " + ", ".join(f"count(*) FILTER (WHERE selected_action = '{v}') AS {k}" for k, v in acts.items()) + """,
 count(*) FILTER (WHERE rule_id = 'RULE_USABLE_NUMERIC_RETAIN') AS usable_numeric_columns,
 count(*) FILTER (WHERE rule_id = 'RULE_USABLE_CATEGORICAL_RETAIN') AS usable_categorical_columns,
 count(*) FILTER (WHERE rule_id LIKE '%EXCLUSION') AS excluded_columns, CAST(0 AS BIGINT) AS leakage_columns, count(*) AS total_decisions_logged FROM steps"""
    value_of = lambda c, k: f"(SELECT {k} FROM st WHERE column_name = '{c}')"
    fill = lambda c: f"coalesce(CAST({c} AS DOUBLE), (SELECT CASE WHEN abs(skew) < 1 THEN mean ELSE med END FROM st WHERE column_name = '{c}'))"
    mode = lambda c: f"coalesce({c}, {value_of(c, 'top_value')})"
    q["cleaned_table"] = EV + f"""SELECT event_id, {r(fill('user_id'), 6)} AS user_id, {mode('event_type')} AS event_type, {r(fill('value'), 6)} AS value,
 {r(fill('balance'), 6)} AS balance, {mode('props')} AS props FROM ev"""
    q["impute_numeric"] = LINE + f"SELECT orderkey, partkey, suppkey, {r(fill('quantity'), 6)} AS quantity, {r(fill('price'), 6)} AS price FROM dirty"
    q["impute_mode"] = EV + f"SELECT event_id, {mode('event_type')} AS event_type, {mode('props')} AS props FROM ev"
    q["log1p_scale_robust"] = EV + f""", filled AS (SELECT event_id, {fill('value')} AS value, balance FROM ev),
shape AS (SELECT abs(skewness(value)) > 1 AND min(value) >= 0 AS take_log FROM filled),
logged AS (SELECT event_id, CASE WHEN take_log THEN ln(1 + greatest(value, 0)) ELSE value END AS value, balance FROM filled CROSS JOIN shape),
{", ".join(f'''{c}_s AS (SELECT *, (SELECT count(*) FROM logged WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / CAST(n AS DOUBLE) AS share
 FROM (SELECT count(*) AS n, avg({c}) AS mean, stddev_pop({c}) AS sd, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM logged))''' for c in ('value', 'balance'))}
SELECT event_id, {", ".join(r(f"(SELECT CASE WHEN share > 0.02 THEN (l.{c} - med) / (q3 - q1) ELSE (l.{c} - mean) / sd END FROM {c}_s)", 6) + f" AS {c}" for c in ('value', 'balance'))} FROM logged l"""
    q["scale_standard"] = f"WITH {DIRTY} SELECT orderkey, partkey, suppkey, " + ", ".join(f"{standard(c)} AS {c}" for c in ("quantity", "price", "discount", "tax")) + " FROM dirty"
    kinds = ["click", "error", "purchase", "signup", "view"]
    q["one_hot"] = EV + f"SELECT event_id, " + ", ".join(f"CASE WHEN {mode('event_type')} = '{k}' THEN 1.0 ELSE 0.0 END AS event_type_{k}" for k in kinds) + " FROM ev"
    q["ordinal"] = EV + f""", dict AS (SELECT props AS v, CAST(row_number() OVER (ORDER BY props) - 1 AS DOUBLE) AS idx FROM (SELECT DISTINCT props FROM ev WHERE props IS NOT NULL))
SELECT event_id, idx AS props_ordinal FROM ev JOIN dict ON {mode('props')} = v"""
    q["plain_ordinal"] = f"""WITH {DIRTY}, dict AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS idx FROM (SELECT DISTINCT coalesce(returnflag, 'nan') AS v FROM dirty))
SELECT orderkey, partkey, suppkey, {standard('quantity')} AS quantity, idx AS returnflag FROM dirty JOIN dict ON coalesce(returnflag, 'nan') = v"""
    q["one_hot_capped"] = union(
        [
            f"SELECT '{c}_' || CASE WHEN rn <= cap THEN v ELSE 'infrequent_sklearn' END AS feature, CAST(sum(k) AS DOUBLE) AS ones, (SELECT count(*) FROM part) AS n FROM"
            f" (SELECT {c} AS v, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn, CASE WHEN (SELECT count(DISTINCT {c}) FROM part) > 15 THEN 14 ELSE 15 END AS cap FROM part GROUP BY {c}) GROUP BY 1"
            for c in ("p_brand", "p_type")
        ]
    )
    q["compare_overall"] = COMPARE + f"""SELECT *, {r("CASE WHEN first_value(missing_values) OVER w = 0 THEN 100 ELSE (max(missing_values) OVER () - min(missing_values) OVER ()) * 100.0 / max(missing_values) OVER () END", 2)} AS missing_resolved_pct FROM (
SELECT 'before' AS side, count(*) AS num_rows, CAST(10 AS BIGINT) AS num_columns, {missing_cells('doubled').replace(' FROM doubled', '')} AS missing_values, CAST({dup('doubled')} AS BIGINT) AS duplicate_rows,
 (SELECT CAST(sum(outliers) AS BIGINT) FROM bf) AS outliers FROM doubled
UNION ALL SELECT 'after', count(*), CAST(10 AS BIGINT), {missing_cells('clean').replace(' FROM clean', '')}, CAST({dup('clean')} AS BIGINT), (SELECT CAST(sum(outliers) AS BIGINT) FROM af) FROM clean)
WINDOW w AS (ORDER BY side DESC)"""
    keys = (("mn", "min"), ("mx", "max"), ("mean", "mean"), ("med", "median"), ("sd", "std"), ("skew", "skewness"))
    q["compare_numeric"] = COMPARE + "SELECT column_name, b.missing AS before_missing, " + r("CAST(b.missing AS DOUBLE) / b.n * 100", 2) + " AS before_missing_pct, a.missing AS after_missing, b.outliers AS before_outliers, a.outliers AS after_outliers, " + ", ".join(
        f"{big(f'{t}.{x}')} AS {s}_{y}" for t, s in (("b", "before"), ("a", "after")) for x, y in keys
    ) + " FROM bf b JOIN af a USING (column_name)"
    q["compare_hist"] = compare_hist()
    q["compare_categories"] = compare_categories()
    q["compare_long_text"] = compare_long_text()
    q["impute_mode_long_text"] = """WITH src AS (SELECT doc_id, CASE WHEN lang = 'en' THEN text END AS text FROM documents),
 mode AS (SELECT text FROM src WHERE text IS NOT NULL GROUP BY text ORDER BY count(*) DESC, text LIMIT 1),
 filled AS (SELECT doc_id, coalesce(text, (SELECT text FROM mode)) AS text FROM src)
SELECT sha256(text) AS digest, count(*) AS cnt, max(doc_id) AS last_id FROM filled GROUP BY text"""
    q["ratio_validate"] = f"""WITH {DIRTY}, rt AS (SELECT *, {ratio('price', 'quantity')} AS unit_price, {ratio('tax', 'discount')} AS tax_share, {ratio('discount', 'price')} AS flat FROM dirty),
m AS (SELECT 'unit_price' AS name, var_pop(unit_price) AS v, greatest(abs(corr(price, unit_price)), abs(corr(quantity, unit_price))) AS c FROM rt
UNION ALL SELECT 'tax_share', var_pop(tax_share), greatest(abs(corr(tax, tax_share)), abs(corr(discount, tax_share))) FROM rt
UNION ALL SELECT 'flat', var_pop(flat), NULL FROM rt),
judged AS (SELECT name, CASE WHEN v < 1e-4 THEN 'RULE_FE_NEAR_ZERO_VARIANCE' WHEN c > 0.98 THEN 'RULE_FE_COLLINEAR_REDUNDANCY' ELSE 'RULE_FE_ACCEPTED_VALID_SIGNAL' END AS rule_id, v, c FROM m)
SELECT name, CASE WHEN rule_id LIKE '%ACCEPTED%' THEN 'accepted' ELSE 'rejected' END AS status, rule_id, {r(r('v', 6), 4)} AS variance, {r('c', 4)} AS max_source_correlation FROM judged
UNION ALL SELECT 'same', 'rejected', 'RULE_FE_NON_NUMERIC_DENOMINATOR', NULL, NULL
UNION ALL SELECT 'void', 'rejected', 'RULE_FE_MISSING_DENOMINATOR', NULL, NULL
UNION ALL SELECT 'leak', 'rejected', 'RULE_FE_EXPLICIT_LEAKAGE', NULL, NULL"""
    q["ratio_apply"] = f"WITH {DIRTY} SELECT orderkey, partkey, suppkey, {r(ratio('price', 'quantity'), 6)} AS unit_price, {r(ratio('tax', 'discount'), 6)} AS tax_share FROM dirty"
    q["select_features"] = SELECTOR + """, v AS (SELECT var_pop(coalesce(tiny, 0)) < 1e-4 AS tiny_flat, abs(corr(coalesce(quantity, 0), coalesce(tripled, 0))) > 0.95 AS q_t,
 abs(corr(coalesce(price, 0), coalesce(half_price, 0))) > 0.95 AS p_h FROM src)
SELECT 'tiny' AS feature, 'RULE_FS_LOW_VARIANCE_FILTER' AS rule_id, 'remove_feature' AS selected_action, CAST(NULL AS VARCHAR) AS kept_feature FROM v WHERE tiny_flat
UNION ALL SELECT 'quantity', 'RULE_FS_HIGH_CORRELATION_PRUNE', 'remove_redundant_feature', 'tripled' FROM v WHERE q_t
UNION ALL SELECT 'half_price', 'RULE_FS_HIGH_CORRELATION_PRUNE', 'remove_redundant_feature', 'price' FROM v WHERE p_h
UNION ALL SELECT unnest(['price', 'discount', 'tax', 'tripled']), 'RULE_FS_FEATURE_RETAINED', 'retain_for_model', NULL"""
    q["anova"] = f"WITH {DIRTY}, src AS (SELECT * FROM dirty) SELECT feature, {r('f', 6)} AS f_statistic FROM ({anova_sql(['quantity', 'price', 'discount', 'tax'], 'returnflag')})"
    q["split_class_counts"] = f"""WITH {DIRTY}, c AS (SELECT linestatus AS class, count(*) AS k FROM dirty GROUP BY 1),
e AS (SELECT *, sum(k) OVER () - ceil(sum(k) OVER () * 0.2) AS n_train, sum(k) OVER () AS n FROM c),
f AS (SELECT *, floor(n_train * k / n) AS base, n_train * k / n - floor(n_train * k / n) AS rest FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY rest DESC, class) AS rn, n_train - sum(base) OVER () AS spare FROM f),
h AS (SELECT class, k, CAST(base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS train FROM g)
SELECT 'train' AS split, class, train AS class_count FROM h UNION ALL SELECT 'test', class, k - train FROM h"""
    q["split_many_classes"] = """WITH c AS (SELECT o_custkey % 60 AS class, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT sum(n)::BIGINT AS n, (sum(n) - ceil(sum(n) * 0.2))::BIGINT AS train FROM c),
e AS (SELECT class, c.n, c.n * t.train::DOUBLE / t.n::DOUBLE AS exact, t.train AS all_train FROM c, t),
f AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, class) AS place, all_train - sum(floor(exact)) OVER () AS spare FROM e)
SELECT class, (n - floor(exact) - CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS test_rows FROM f"""
    q["split_plain"] = """SELECT 'train' AS split, count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS split_rows FROM orders
UNION ALL SELECT 'test', CAST(ceil(count(*) * 0.2) AS BIGINT) FROM orders"""
    q["confusion"] = f"""WITH {SCORED} SELECT t AS truth, p AS predicted, (SELECT count(*) FROM scored WHERE flag = t AND flag_predicted = p) AS cnt
 FROM (SELECT unnest(['A', 'N', 'R']) AS t) CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS p)"""
    q["class_report"] = REPORT + f"""SELECT class AS label, {r('p', 4)} AS precision, {r('rc', 4)} AS recall, {r('f1', 4)} AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', {r('sum(hits) / CAST(sum(support) AS DOUBLE)', 4)}, {r('sum(hits) / CAST(sum(support) AS DOUBLE)', 4)}, {r('sum(hits) / CAST(sum(support) AS DOUBLE)', 4)}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', {r('avg(p)', 4)}, {r('avg(rc)', 4)}, {r('avg(f1)', 4)}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', {r('sum(p * support) / sum(support)', 4)}, {r('sum(rc * support) / sum(support)', 4)}, {r('sum(f1 * support) / sum(support)', 4)}, CAST(sum(support) AS BIGINT) FROM f"""
    q["binary_metrics"] = BINARY
    q["roc_auc_ovr"] = f"WITH {SCORED} " + union(
        [f"SELECT CAST({i} AS BIGINT) AS class_index, {r(auc(f'''flag = '{c}' ''', s), 6)} AS auc" for i, (c, s) in enumerate((("A", "p_a"), ("N", "p_n"), ("R", "p_r")))]
    )
    q["roc_auc_many_classes"] = f"""WITH s AS (SELECT c, CAST(o_custkey % 60 = c AS INTEGER) AS hit,
 (o_orderkey * (c + 7) + CAST(floor(o_totalprice) AS BIGINT)) % 997 + CASE WHEN o_custkey % 60 = c THEN 60 + 5 * c ELSE 0 END AS score FROM orders CROSS JOIN (SELECT unnest(range(60)) AS c)),
t AS (SELECT c, score, sum(hit) AS pos, sum(1 - hit) AS neg FROM s GROUP BY c, score),
w AS (SELECT c, pos, neg, neg * (sum(pos) OVER (PARTITION BY c ORDER BY score DESC) - pos / 2.0) AS wins FROM t)
SELECT CAST(c AS BIGINT) AS class_index, {r('CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(wins) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END', 6)} AS auc FROM w GROUP BY c"""
    q["csv_roundtrip_text"] = """SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents
UNION ALL SELECT event_id, 'ev', event_type, length(props), md5('say "' || props || '",' || chr(10)) FROM events"""
    q["one_hot_hard_names"] = """SELECT label, count(*)::DOUBLE AS ones FROM (
SELECT 0 AS part, 'city_St. ' || replace(o_orderpriority, '-', '`') AS label FROM orders
UNION ALL SELECT 1, CASE WHEN o_orderkey % 2 = 0 THEN 'a_b_c' ELSE 'a_x' END FROM orders
UNION ALL SELECT 2, CASE WHEN o_orderkey % 3 = 0 THEN 'a_b_c' ELSE 'a_b_y' END FROM orders) GROUP BY part, label"""
    q["csv_roundtrip"] = f"""WITH {DIRTY} SELECT count(*) AS n, count(quantity) AS quantities, count(returnflag) AS flags, {r('sum(price)', 2)} AS price_sum,
 CAST(sum(linenumber) AS BIGINT) AS line_sum, max(linestatus) AS last_status FROM dirty"""
    q["preview_rows"] = "SELECT * FROM nation ORDER BY n_nationkey LIMIT 10"
    return q
