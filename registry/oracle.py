"""SQL twins of the operators, written for the checker's database."""

from __future__ import annotations

from itertools import combinations

from tabsight.functions import normal
from tabsight.operators import shape


def r(expression: str, digits: int = 6) -> str:
    """Rounded; adding zero turns -0.0 into 0.0."""
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def union(parts) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def G1(c: str) -> str:
    return f"CASE WHEN count({c}) >= 3 THEN CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END END"


def G2(c: str) -> str:
    return f"CASE WHEN count({c}) >= 4 THEN CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE kurtosis({c}) END END"


def _q(c: str, src: str) -> str:
    return (
        f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2, "
        f"quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {src}) b"
    )


def numeric_univariate(src: str, columns, digits: int = 6) -> str:
    parts = []
    for i, c in enumerate(columns):
        x = f"x.{c}::DOUBLE"
        parts.append(
            f"""SELECT {i} AS position, '{c}' AS "column", count({x}) AS count, {r(f'avg({x})', digits)} AS mean,
            {r('any_value(b.q2)', digits)} AS median, {r(f'stddev_samp({x})', digits)} AS std,
            {r(G1(x), digits)} AS skewness, {r(G2(x), digits)} AS kurtosis, min({x}) AS min, max({x}) AS max,
            {r('any_value(b.q1)', digits)} AS q1, {r('any_value(b.q3)', digits)} AS q3,
            {r('any_value(b.q3 - b.q1)', digits)} AS iqr,
            {r('any_value(b.q1 - 1.5 * (b.q3 - b.q1))', digits)} AS outlier_lower_bound,
            {r('any_value(b.q3 + 1.5 * (b.q3 - b.q1))', digits)} AS outlier_upper_bound,
            count(*) FILTER (WHERE {x} < b.q1 - 1.5 * (b.q3 - b.q1) OR {x} > b.q3 + 1.5 * (b.q3 - b.q1)) AS outlier_count,
            {r(f'stddev_samp({x}) / nullif(avg({x}), 0)', digits)} AS cv, NULL::VARCHAR AS error
            FROM {src} x, {_q(c, src)}"""
        )
    return union(parts)


def value_counts(src: str, columns) -> str:
    return union(
        f"""SELECT {i} AS position, '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS count
        FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for i, c in enumerate(columns)
    )


def categorical_univariate(src: str, columns) -> str:
    return f"""SELECT position, "column", sum(count)::BIGINT AS count, count(*) AS cardinality,
        arg_min(value, (-count, value)) AS mode, max(count) AS mode_frequency,
        {r('max(count) / sum(count) * 100', 2)} AS mode_pct, NULL::VARCHAR AS error
        FROM ({value_counts(src, columns)}) GROUP BY position, "column" """


def top_values(src: str, columns, n: int = 10) -> str:
    return f"""SELECT "column", rank, value, count FROM (SELECT *, row_number() OVER
        (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM ({value_counts(src, columns)})) WHERE rank <= {n}"""


def correlations(src: str, columns, digits: int | None = 6) -> str:
    parts = []
    for (i, a), (j, b) in combinations(enumerate(columns), 2):
        value = f"corr({a}::DOUBLE, {b}::DOUBLE)"
        value = value if digits is None else r(value, digits)
        parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, {value} AS r FROM {src}")
    return union(parts)


def strong(src: str, columns, digits: int = 6) -> str:
    return f"""SELECT a, b, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
        {r('r', digits)} AS correlation FROM ({correlations(src, columns, None)}) WHERE abs(r) >= 0.7"""


def groups(src: str, categories, numbers) -> str:
    return union(
        f"""SELECT {ci} AS c_pos, '{c}' AS category, {ni} AS n_pos, '{n}' AS number, {c}::VARCHAR AS grp, avg({n}::DOUBLE) AS mean,
        quantile_cont({n}::DOUBLE, 0.5) AS median, stddev_samp({n}::DOUBLE) AS std, count({n}) AS count
        FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for ci, c in enumerate(categories)
        for ni, n in enumerate(numbers)
    )


def distinct_gate(src: str, columns) -> str:
    return union(
        f"SELECT '{c}' AS category, count(DISTINCT {c}) AS distinct_n FROM {src}" for c in columns
    )


def grouped_statistics(src: str, categories, numbers, digits: int = 4) -> str:
    return f"""WITH g AS (SELECT * FROM ({groups(src, categories, numbers)}) JOIN ({distinct_gate(src, categories)}) USING (category)
        WHERE distinct_n <= 50 AND mean IS NOT NULL AND median IS NOT NULL AND std IS NOT NULL),
        p AS (SELECT category, number, {r('var_samp(mean)', digits)} AS mean_variance, min(c_pos) AS c_pos, min(n_pos) AS n_pos
        FROM g GROUP BY category, number),
        k AS (SELECT *, row_number() OVER (ORDER BY mean_variance DESC NULLS LAST, c_pos, n_pos) AS pair_rank FROM p)
        SELECT pair_rank::INTEGER AS pair_rank, g.category AS categorical, g.number AS numeric, mean_variance, grp AS "group",
        {r('mean', digits)} AS mean, {r('median', digits)} AS median, {r('std', digits)} AS std, count
        FROM g JOIN k ON g.category = k.category AND g.number = k.number WHERE pair_rank <= 20"""


def association(src: str, a: str, b: str, digits: int = 6) -> str:
    """One row (a, b, cramers_v, n, n_rows, n_cols) by expected counts of the full table."""
    return f"""WITH o AS (SELECT {a}::VARCHAR AS a, {b}::VARCHAR AS b, count(*) AS o FROM {src}
        WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
        ra AS (SELECT a, sum(o) AS rt FROM o GROUP BY a), cb AS (SELECT b, sum(o) AS ct FROM o GROUP BY b),
        t AS (SELECT sum(o) AS n, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc FROM o),
        f AS (SELECT coalesce(o.o, 0)::DOUBLE AS o, ra.rt * cb.ct / t.n::DOUBLE AS e, t.n, t.nr, t.nc
        FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),
        d AS (SELECT *, CASE WHEN nr = 2 AND nc = 2 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END AS gap FROM f)
        SELECT '{a}' AS a, '{b}' AS b, {r('sqrt(sum(gap * gap / e) / (any_value(n) * (least(any_value(nr), any_value(nc)) - 1)))', digits)} AS cramers_v,
        any_value(n)::BIGINT AS n, any_value(nr) AS n_rows, any_value(nc) AS n_cols FROM d"""


def auto_histogram(src: str, columns, whole=()) -> str:
    parts = []
    for c in columns:
        x = f"{c}::DOUBLE"
        floor = "greatest(w, 1.0)" if c in whole else "w"
        parts.append(
            f"""SELECT '{c}' AS "column", bin, lo + bin * ((hi - lo) / bins) AS low, lo + (bin + 1) * ((hi - lo) / bins) AS high,
            coalesce(count, 0) AS count FROM (WITH s AS (SELECT count({x}) AS n, min({x}) AS lo, max({x}) AS hi,
            quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {src}),
            w AS (SELECT *, least(greatest(2.0 * (q3 - q1) * pow(n, -1.0 / 3.0), (hi - lo) / sqrt(n) / 2), (hi - lo) / (log2(n) + 1.0)) AS w FROM s),
            b AS (SELECT *, CASE WHEN w > 0 THEN ceil((hi - lo) / {floor})::BIGINT ELSE 1 END AS bins FROM w),
            k AS (SELECT least(floor(({x} - lo) * bins / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END)::BIGINT, bins - 1) AS bin, count(*) AS count
            FROM {src}, b WHERE {c} IS NOT NULL GROUP BY 1)
            SELECT e.bin, b.lo, b.hi, b.bins, k.count FROM b, LATERAL (SELECT unnest(range(b.bins)) AS bin) e LEFT JOIN k ON k.bin = e.bin)"""
        )
    return union(parts)


def peaks(src: str, columns, whole=()) -> str:
    return f"""SELECT "column", count(*) AS bins, count(*) FILTER (WHERE peak) AS peaks,
        count(*) FILTER (WHERE peak) >= 2 AS is_multimodal FROM (SELECT "column",
        count > lag(count) OVER w AND count > lead(count) OVER w AS peak
        FROM ({auto_histogram(src, columns, whole)}) WINDOW w AS (PARTITION BY "column" ORDER BY bin)) GROUP BY "column" """


def normality(src: str, columns) -> str:
    """K-squared from skewness and kurtosis of all values."""
    parts = []
    for c in columns:
        x = f"{c}::DOUBLE"
        parts.append(
            f"""SELECT '{c}' AS "column", n::BIGINT AS n, {r('k2', 3)} AS k2, {r('exp(-k2 / 2)', 6)} AS p_value, exp(-k2 / 2) > 0.05 AS is_normal
            FROM (SELECT *, pow(asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)), 2)
            + pow((1 - 2 / (9 * a) - sign(below) * cbrt((1 - 2 / a) / abs(below))) / sqrt(2 / (9 * a)), 2) AS k2
            FROM (SELECT *, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
            1 + x * sqrt(2 / (a - 4)) AS below FROM (SELECT *, 6 + 8 / third * (2 / third + sqrt(1 + 4 / (third * third))) AS a
            FROM (SELECT n, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
            (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
            6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS third
            FROM (SELECT count({x})::DOUBLE AS n, avg(pow({x} - m, 3)) / pow(avg(pow({x} - m, 2)), 1.5::DOUBLE) AS g1,
            avg(pow({x} - m, 4)) / pow(avg(pow({x} - m, 2)), 2) AS b2 FROM {src}, (SELECT avg({x}) AS m FROM {src}))))))"""
        )
    return union(parts)


def _horner(x: str, coefficients) -> str:
    made = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        made = f"({made} * {x} + {c!r}::DOUBLE)"
    return made


def normal_quantile(p: str) -> str:
    """AS241, p an expression."""
    q, tail = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - ({p}))))"

    def ratio(x, parts):
        return f"{_horner(x, parts[0])} / {_horner(x, parts[1])}"

    return f"""CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(f"(0.180625 - {q} * {q})", normal.MIDDLE)}
        WHEN {tail} <= 5 THEN sign({q}) * {ratio(f"({tail} - 1.6)", normal.TAIL)} ELSE sign({q}) * {ratio(f"({tail} - 5)", normal.FAR)} END"""


def shapiro_wilk(src: str, column: str) -> str:
    """W and its normal score of a column of more than 11 values, every weight written out."""
    last, before = _horner("u", shape.ROYSTON_LAST), _horner("u", shape.ROYSTON_LAST_BUT_ONE)
    return f"""SELECT '{column}' AS "column", n::BIGINT AS n, {r('w', 5)} AS w,
        {r(f"(ln(1 - w) - {_horner('ln(n)', shape.ROYSTON_MEAN)}) / exp({_horner('ln(n)', shape.ROYSTON_SPREAD)})", 3)} AS z, n <= 5000 AS fitted
        FROM (SELECT n, pow(sum(d * CASE WHEN i = n THEN a WHEN i = 1 THEN -a WHEN i = n - 1 THEN b WHEN i = 2 THEN -b
        ELSE m / sqrt((mm - 2 * outermost * outermost - 2 * nextmost * nextmost) / (1 - 2 * a * a - 2 * b * b)) END), 2) / sum(d * d) AS w
        FROM (SELECT *, outermost / sqrt(mm) + {last} AS a, nextmost / sqrt(mm) + {before} AS b
        FROM (SELECT *, 1 / sqrt(n) AS u, sum(m * m) OVER () AS mm, max(m) OVER () AS outermost, max(CASE WHEN i = n - 1 THEN m END) OVER () AS nextmost
        FROM (SELECT i, n, x - mean AS d, {normal_quantile("((i - 0.375) / (n + 0.25))")} AS m
        FROM (SELECT {column}::DOUBLE AS x, row_number() OVER (ORDER BY {column})::DOUBLE AS i, count(*) OVER ()::DOUBLE AS n,
        avg({column}::DOUBLE) OVER () AS mean FROM {src} WHERE {column} IS NOT NULL)))) GROUP BY n)"""


def shapes(src: str, columns, whole=(), digits: int = 6) -> str:
    """Shape labels of columns with at least eight values."""
    moments = union(
        f"""SELECT {i} AS position, '{c}' AS "column", {G1(c + '::DOUBLE')} AS s, {G2(c + '::DOUBLE')} AS k FROM {src}"""
        for i, c in enumerate(columns)
    )
    return f"""SELECT position, "column", CASE WHEN is_multimodal THEN 'multimodal' WHEN is_normal THEN 'normal'
        WHEN abs(s) < 0.5 THEN CASE WHEN k > 2 THEN 'heavy_tailed' WHEN k < -1 THEN 'light_tailed' ELSE 'approximately_normal' END
        WHEN s >= 0.5 THEN 'right_skewed' ELSE 'left_skewed' END AS distribution_type,
        {r('s', digits)} AS skewness, {r('k', digits)} AS kurtosis, p_value AS normality_p_value, is_multimodal
        FROM ({moments}) JOIN ({peaks(src, columns, whole)}) USING ("column") JOIN ({normality(src, columns)}) USING ("column")"""


def categorical_segments(src: str, categories, numbers, digits: int = 6) -> str:
    spread = union(f"SELECT '{n}' AS number, stddev_samp({n}::DOUBLE) AS overall FROM {src}" for n in numbers)
    return f"""WITH g AS (SELECT * FROM ({groups(src, categories, numbers)}) JOIN ({distinct_gate(src, categories)}) USING (category)
        WHERE distinct_n BETWEEN 2 AND 15),
        e AS (SELECT category, number, (max(mean) - min(mean)) / nullif(any_value(overall), 0) AS effect
        FROM g JOIN ({spread}) USING (number) GROUP BY category, number HAVING max(count) >= 5)
        SELECT g.category AS split_column, g.number AS target_column, {r('effect', digits)} AS effect_size, grp AS "group",
        {r('mean', digits)} AS group_mean, count AS group_count
        FROM g JOIN e ON g.category = e.category AND g.number = e.number WHERE effect >= 0.3"""


def numeric_segments(src: str, numbers) -> str:
    return union(
        f"""SELECT '{c}' AS "column", count(x.{c}) AS n, {G1(f'x.{c}::DOUBLE')} AS skew, any_value(b.q2) AS median,
        count(*) FILTER (WHERE x.{c} <= b.q2) AS below, count(*) FILTER (WHERE x.{c} > b.q2) AS above,
        any_value(b.q1 - 1.5 * (b.q3 - b.q1)) AS lo, any_value(b.q3 + 1.5 * (b.q3 - b.q1)) AS hi,
        count(*) FILTER (WHERE x.{c} < b.q1 - 1.5 * (b.q3 - b.q1) OR x.{c} > b.q3 + 1.5 * (b.q3 - b.q1)) AS outliers
        FROM {src} x, {_q(c, src)}"""
        for c in numbers
    )


def skew_split(src: str, numbers, digits: int = 6) -> str:
    return f"""SELECT "column", median AS threshold, {r('skew', digits)} AS skewness, below AS below_median_count,
        above AS above_median_count FROM ({numeric_segments(src, numbers)}) WHERE n >= 10 AND abs(skew) >= 1"""


def outlier_segments(src: str, numbers, digits: int = 6) -> str:
    return f"""SELECT "column", outliers AS outlier_count, {r('outliers * 100.0::DOUBLE / n', 2)} AS outlier_pct,
        {r('lo', digits)} AS lower_bound, {r('hi', digits)} AS upper_bound
        FROM ({numeric_segments(src, numbers)}) WHERE n >= 10 AND outliers > 0"""


def segments(src: str, categories, numbers, digits: int = 6) -> str:
    return f"""SELECT 'categorical_split' AS type, split_column, target_column AS "column", effect_size, count(*) AS groups,
        NULL::DOUBLE AS threshold, NULL::DOUBLE AS skewness, NULL::BIGINT AS below_median_count, NULL::BIGINT AS above_median_count,
        NULL::BIGINT AS outlier_count, NULL::DOUBLE AS outlier_pct, NULL::DOUBLE AS lower_bound, NULL::DOUBLE AS upper_bound
        FROM ({categorical_segments(src, categories, numbers, digits)}) GROUP BY ALL
        UNION ALL SELECT 'numeric_threshold', NULL, "column", NULL, NULL, threshold, skewness, below_median_count, above_median_count,
        NULL, NULL, NULL, NULL FROM ({skew_split(src, numbers, digits)})
        UNION ALL SELECT 'outlier_segment', NULL, "column", NULL, NULL, NULL, NULL, NULL, NULL, outlier_count, outlier_pct,
        lower_bound, upper_bound FROM ({outlier_segments(src, numbers, digits)})"""


def series(src: str, order: str, numbers) -> str:
    return union(
        f"""SELECT {i} AS position, '{n}' AS "column", row_number() OVER (ORDER BY {order}) - 1 AS pos, {n}::DOUBLE AS value
        FROM {src} WHERE {n} IS NOT NULL"""
        for i, n in enumerate(numbers)
    )


def trend(src: str, order: str, numbers, digits: int = 6) -> str:
    return f"""SELECT "column", n, CASE WHEN abs(slope) < 1e-10 THEN 'flat' WHEN slope > 0 THEN 'upward' ELSE 'downward' END AS trend,
        {r('slope', 6)} AS slope, {r('r2', digits)} AS r_squared, {r('intercept', digits)} AS intercept
        FROM (SELECT "column", count(*) AS n, regr_slope(value, pos) AS slope, regr_r2(value, pos) AS r2,
        regr_intercept(value, pos) AS intercept FROM ({series(src, order, numbers)}) GROUP BY "column")"""


def acf(src: str, order: str, numbers, digits: int | None = 6) -> str:
    lags = range(1, 61)
    earlier = ", ".join(f"lag(value, {k}) OVER w AS e{k}" for k in lags)
    each = ", ".join(f"corr(value, e{k}) AS r{k}" for k in lags)
    value = "r" if digits is None else r("r", digits)
    return f"""SELECT "column", substr(name, 2)::INTEGER AS lag, {value} AS r FROM (UNPIVOT (SELECT "column", {each}
        FROM (SELECT "column", value, {earlier} FROM ({series(src, order, numbers)}) WINDOW w AS (PARTITION BY "column" ORDER BY pos))
        GROUP BY "column") ON COLUMNS('^r[0-9]+$') INTO NAME name VALUE r)"""


def seasonality(src: str, order: str, numbers, digits: int = 6) -> str:
    return f"""WITH c AS ({acf(src, order, numbers, None)}),
        p AS (SELECT "column", lag, r, lag(r) OVER w AS before, lead(r) OVER w AS after FROM c WINDOW w AS (PARTITION BY "column" ORDER BY lag)),
        k AS (SELECT "column", lag, {r('r', digits)} AS acf FROM p WHERE r > before AND r > after AND r > 0.2),
        best AS (SELECT "column", arg_min(lag, (-acf, lag)) AS lag, max(acf) AS acf FROM k GROUP BY "column")
        SELECT names."column", CASE WHEN best.lag IS NULL THEN 'not_detected' ELSE 'detected' END AS seasonality,
        best.lag AS dominant_period_lag, best.acf AS acf_at_dominant
        FROM (VALUES {", ".join(f"('{n}')" for n in numbers)}) names("column") LEFT JOIN best ON best."column" = names."column" """


def time_series(src: str, order: str, numbers, digits: int = 6) -> str:
    places = ", ".join(f"({i}, '{n}')" for i, n in enumerate(numbers))
    return f"""SELECT position, "column", 'ok' AS status, trend, slope, r_squared, intercept, seasonality, dominant_period_lag, acf_at_dominant
        FROM (VALUES {places}) names(position, "column") JOIN ({trend(src, order, numbers, digits)}) USING ("column")
        JOIN ({seasonality(src, order, numbers, digits)}) USING ("column")"""


def gap_text(us: str) -> str:
    seconds = f"({us} // 1000000)"
    clock = (
        f"printf('%d days %02d:%02d:%02d', {seconds} // 86400, ({seconds} % 86400) // 3600, "
        f"({seconds} % 3600) // 60, {seconds} % 60)"
    )
    return f"CASE WHEN {us} % 1000000 = 0 THEN {clock} ELSE {clock} || printf('.%06d', {us} % 1000000) END"


def datetime_univariate(src: str, column: str) -> str:
    return f"""WITH d AS (SELECT epoch_us({column}) AS t, epoch_us({column}) - lag(epoch_us({column})) OVER (ORDER BY {column}) AS gap
        FROM {src} WHERE {column} IS NOT NULL),
        m AS (SELECT gap FROM d WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1)
        SELECT '{column}' AS "column", count({column}) AS count, min({column})::VARCHAR AS min, max({column})::VARCHAR AS max,
        (epoch_us(max({column})) - epoch_us(min({column}))) // 86400000000 AS range_days, count(*) - count({column}) AS null_count,
        (SELECT {gap_text('gap')} FROM m) AS inferred_frequency, NULL::VARCHAR AS error FROM {src}"""


def regression_metrics(src: str, digits: int = 4) -> str:
    return f"""SELECT model, {r('avg(abs(actual - predicted))', digits)} AS mae, {r('sqrt(avg((actual - predicted) ** 2))', digits)} AS rmse,
        {r('1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*))', digits)} AS r2,
        {r('avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100', 2)} AS mape, count(*) AS test_rows
        FROM {src} GROUP BY model"""


def classification_metrics(src: str, positive: str = "1", digits: int = 4) -> str:
    return f"""WITH p AS (SELECT model, actual::VARCHAR AS a, predicted::VARCHAR AS p FROM {src}),
        l AS (SELECT DISTINCT model, a AS label FROM p UNION SELECT DISTINCT model, p FROM p),
        s AS (SELECT l.model, l.label, count(*) FILTER (WHERE a = label AND p.p = label) AS tp, count(*) FILTER (WHERE a = label) AS an,
        count(*) FILTER (WHERE p.p = label) AS pn FROM l JOIN p ON p.model = l.model GROUP BY 1, 2),
        f AS (SELECT *, coalesce(tp / nullif(pn, 0)::DOUBLE, 0) AS precision_, coalesce(tp / nullif(an, 0)::DOUBLE, 0) AS recall_,
        coalesce(2 * tp / nullif(an + pn, 0)::DOUBLE, 0) AS f1_ FROM s)
        SELECT model, {r('sum(tp) / sum(an)::DOUBLE', digits)} AS accuracy,
        {', '.join(r(f"CASE WHEN count(*) FILTER (WHERE an > 0) <= 2 THEN coalesce(max(CASE WHEN label = '{positive}' THEN {m}_ END), 0) ELSE avg({m}_) END", digits) + ' AS ' + m for m in ('precision', 'recall', 'f1'))},
        sum(an)::BIGINT AS test_rows FROM f GROUP BY model"""


def histogram30(src: str, column: str, bins: int = 30, name: str | None = None) -> str:
    x = f"({column})::DOUBLE"
    return f"""SELECT '{name or column}' AS "column", e.bin, lo + e.bin * ((hi - lo) / bins) AS low, lo + (e.bin + 1) * ((hi - lo) / bins) AS high,
        coalesce(k.count, 0) AS count FROM (SELECT min({x}) AS lo, max({x}) AS hi, CASE WHEN max({x}) > min({x}) THEN {bins} ELSE 1 END AS bins FROM {src}) b,
        LATERAL (SELECT unnest(range(b.bins)) AS bin) e LEFT JOIN
        (SELECT least(floor(({x} - lo) * bins / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END)::BIGINT, bins - 1) AS bin, count(*) AS count
        FROM {src}, (SELECT min({x}) AS lo, max({x}) AS hi, CASE WHEN max({x}) > min({x}) THEN {bins} ELSE 1 END AS bins FROM {src})
        WHERE {x} IS NOT NULL GROUP BY 1) k ON k.bin = e.bin"""


def scatter(src: str, x: str, y: str, bins: int = 40) -> str:
    def at(c, s):
        return f"least(floor(({c}::DOUBLE - {s}lo) * {bins} / ({s}hi - {s}lo))::BIGINT, {bins - 1})"

    return f"""WITH p AS (SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
        b AS (SELECT min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi FROM p)
        SELECT {at('x', 'x')} AS x_bin, {at('y', 'y')} AS y_bin, count(*) AS count FROM p, b GROUP BY ALL"""


def column_summary(src: str, columns, digits: int = 4) -> str:
    """``columns``: (name, dtype, class)."""
    parts = []
    for i, (c, dtype, kind) in enumerate(columns):
        mean = r(f"avg({c}::DOUBLE)", digits) if kind == "numeric" else "NULL::DOUBLE"
        shown = {"numeric": "::DOUBLE::VARCHAR", "datetime": "::VARCHAR"}.get(kind)
        low, high = (f"min({c}){shown}", f"max({c}){shown}") if shown else ("NULL::VARCHAR", "NULL::VARCHAR")
        top = (
            f"(SELECT {c}::VARCHAR FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
            if kind == "categorical"
            else "NULL::VARCHAR"
        )
        parts.append(
            f"""SELECT {i} AS position, '{c}' AS "column", '{dtype}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS null_count,
            {r(f'(count(*) - count({c})) * 100.0::DOUBLE / count(*)', 2)} AS null_pct, count(DISTINCT {c}) AS "unique", {mean} AS mean,
            {low} AS min, {high} AS max, {top} AS top_value FROM {src}"""
        )
    return union(parts)


def identifier_table(src: str, columns) -> str:
    words = ("id", "uuid", "guid", "key", "code", "token")
    return union(
        f"""SELECT '{c}' AS "column", {'count(*) >= 0' if any(w in c.lower() for w in words) else
        f'count(DISTINCT {c}) >= 0.95 * greatest(count({c}), 1)'} AS identifier_like FROM {src}"""
        for c in columns
    )
