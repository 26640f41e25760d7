"""The same answers in plain SQL over the same tables, for a second engine.

Statements are put together from the list of columns below; nothing here uses
the operators. Catalogues and derived tables are shared, being given data.
"""

from __future__ import annotations

from plumbline.functions.catalog import MODELS, REQUIREMENTS, TIERS
from plumbline.plans.queries import (
    DERIVED, EXPECTED, GENERATED_AT, LIBRARY, MODEL_DATA, OWN_REQUIREMENTS, REPLY, SOURCES, TYPED,
)

# (column, type) per table: i int, l bigint, d double, s text, t timestamp,
# day date, a array of float.
FIELDS = {
    "region": "r_regionkey i, r_name s",
    "customer": "c_custkey l, c_name s, c_nationkey i, c_acctbal d, c_mktsegment s",
    "part": "p_partkey l, p_name s, p_brand s, p_type s, p_size i, p_retailprice d",
    "orders": "o_orderkey l, o_custkey l, o_orderstatus s, o_totalprice d, o_orderdate t, o_orderpriority s",
    "lineitem": "l_orderkey l, l_partkey l, l_suppkey l, l_linenumber i, l_quantity d, l_extendedprice d, "
    "l_discount d, l_tax d, l_returnflag s, l_linestatus s, l_shipdate t",
    "events": "event_id l, ts t, user_id l, event_type s, value d, props s",
    "documents": "doc_id l, text s, lang s, source s, n_chars l",
    "embeddings": "vec_id l, embedding a, label i",
    "pages": "page_id l, url s, html s",
    "benchmark": "item_id l, text s",
    "labels": "doc_id l, quality i, toxic i",
    "conversations": "conv_id l, turn l, role s, text s",
    "events_holes": "event_id l, ts t, user_id l, event_type s, value d, value_cubed d, props s",
    "events_sparse": "event_id l, value d, user_id l",
    "lineitem_holes": "l_quantity d, l_extendedprice d, l_discount d, l_tax d, l_linenumber i, l_returnflag s, "
    "l_linestatus s, l_shipdate day",
    "lineitem_flags": "l_returnflag s, l_linestatus s",
    "orders_text_dates": "o_orderkey l, o_orderdate s, o_day_first s, o_month_name s, o_comment s, o_orderpriority s",
    "orders_written_dates": "o_month_between s, o_compact s, o_dotted s, o_zoned s, o_code s, o_no_day s",
    "documents_text": "text s",
    "events_infinite": "event_id l, value d",
    "returns": "target i, l_quantity d, l_extendedprice d, l_discount d, l_tax d, l_linenumber i, net_price d, "
    "big_discount d, always i, l_linestatus s",
    "prices": "target d, o_custkey l, o_orderstatus s, o_orderpriority s, half_price d",
}
FIELDS["combined"] = ", ".join(FIELDS[s] for s in SOURCES)
KINDS = {"i": "integer", "l": "integer", "d": "real", "s": "string", "t": "instant", "day": "instant", "a": "other"}
DTYPES = {"i": "int", "l": "bigint", "d": "double", "s": "string", "t": "timestamp_ntz", "day": "date", "a": "array<float>"}
# Days other than ISO ones, in the order they are tried.
DAYS = [
    ("%m/%d/%Y", "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), ("%d/%m/%Y", "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("%Y/%m/%d", "^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), ("%b %d, %Y", "^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$"),
    ("%d-%b-%Y", "^[0-9]{1,2}-[A-Z][a-z]{2}-[0-9]{4}$"), ("%Y%m%d", "^(19|20)[0-9]{6}$"),
    ("%m.%d.%Y", "^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$"), ("%d.%m.%Y", "^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$"),
]
WIDTHS = {"i": 4, "l": 8, "d": 8, "t": 8, "day": 4}


def fields(name):
    return [tuple(f.split()) for f in FIELDS[name].split(", ")]


def source(name):
    if name in ("returns", "prices"):
        # decimals of literals would meet doubles otherwise
        return "(" + DERIVED[name].replace("THEN 0.0", "THEN 0.0::DOUBLE") + ")"
    return f"({DERIVED[name]})" if name in DERIVED else name


def union(parts):
    return "\nUNION ALL\n".join(parts)


def quote(text):
    return "'" + text.replace("'", "''") + "'"


def array(items):
    return "[" + ", ".join(quote(i) for i in items) + "]"


def values(rows, columns):
    return "(VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows) + f") v({columns})"


# ------------------------------------------------------------------- column facts


def column_facts(names, only=None):
    """One row per column with all raw statistics."""
    parts = []
    for name in names:
        for position, (c, t) in enumerate(fields(name)):
            if only and not only(c, t):
                continue
            parts.append(_facts(name, position, c, t))
    return union(parts)


def _facts(name, position, c, t):
    head = (
        f"SELECT {quote(name)} AS dataset, {position} AS position, {quote(c)} AS \"column\", "
        f"{quote(DTYPES[t])} AS dtype, {quote(KINDS[t])} AS kind"
    )
    src = f"(SELECT {c} AS x FROM {source(name)})"
    counts = "count(*) AS n_total, count(*) - count(x) AS n_null"
    no_numbers = (
        "NULL::DOUBLE AS mn, NULL::DOUBLE AS mx, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, "
        "NULL::DOUBLE AS q1, NULL::DOUBLE AS median, NULL::DOUBLE AS q3, NULL::DOUBLE AS skewness, "
        "NULL::DOUBLE AS kurtosis, NULL::BIGINT AS n_zero, NULL::BIGINT AS n_out"
    )
    no_words = "NULL::DOUBLE AS avg_length, FALSE AS date_like, NULL::VARCHAR AS date_min, NULL::VARCHAR AS date_max"
    if t == "a":
        return f"{head}, {counts}, NULL::BIGINT AS n_unique, {no_numbers}, {no_words}, 4 * sum(len(x))::BIGINT AS n_bytes FROM {src}"
    if t in "ts" or t == "day":
        unique = "count(DISTINCT x) AS n_unique"
        if t == "s":
            # a time with an offset is an instant, given in UTC
            stamps = ["CASE WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}.*:[0-9]{2}[+-][0-9]{2}:[0-9]{2}$') THEN "
                      "make_timestamp(epoch_us(TRY_CAST(x AS TIMESTAMPTZ))) "
                      "WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(x AS TIMESTAMP) END"]  # fmt: skip
            stamps += [f"CASE WHEN regexp_matches(x, {quote(shape)}) THEN try_strptime(x, {quote(fmt)}) END" for fmt, shape in DAYS]
            fits = [f"(count(x) > 0 AND count({s}) = count(x))" for s in stamps]
            first = lambda f: f"CAST(CASE {' '.join(f'WHEN {a} THEN {f}({s})' for a, s in zip(fits, stamps))} ELSE {f}({stamps[0]}) END AS VARCHAR)"
            words = (
                f"avg(length(x)) AS avg_length, ({' OR '.join(fits)}) AS date_like, "
                f"{first('min')} AS date_min, {first('max')} AS date_max, "
                "coalesce(sum(strlen(x)), 0)::BIGINT AS n_bytes"
            )
        else:
            words = (
                "NULL::DOUBLE AS avg_length, FALSE AS date_like, CAST(min(x::TIMESTAMP) AS VARCHAR) AS date_min, "
                f"CAST(max(x::TIMESTAMP) AS VARCHAR) AS date_max, count(*) * {WIDTHS[t]} AS n_bytes"
            )
        return f"{head}, {counts}, {unique}, {no_numbers}, {words} FROM {src}"
    whole = (
        f"(SELECT {counts}, count(DISTINCT x) AS n_unique, min(x)::DOUBLE AS mn, max(x)::DOUBLE AS mx, "
        "avg(x::DOUBLE) AS mean, stddev_samp(x::DOUBLE) AS std, quantile_cont(x::DOUBLE, 0.25) AS q1, "
        f"quantile_cont(x::DOUBLE, 0.5) AS median, quantile_cont(x::DOUBLE, 0.75) AS q3 FROM {src}) w"
    )
    off = "(x::DOUBLE - w.mean)"
    parts = (
        f"(SELECT avg({off} * {off}) AS m2, avg({off} * {off} * {off}) AS m3, "
        f"avg({off} * {off} * {off} * {off}) AS m4, count(*) FILTER (x = 0) AS n_zero, "
        "count(*) FILTER (x < w.q1 - 1.5 * (w.q3 - w.q1) OR x > w.q3 + 1.5 * (w.q3 - w.q1)) AS n_out "
        f"FROM {src}, {whole}) m"
    )
    return (
        f"{head}, n_total, n_null, n_unique, mn, mx, mean, std, q1, median, q3, "
        "CASE WHEN mn < mx THEN m3 / pow(m2, 1.5) END AS skewness, "
        "CASE WHEN mn < mx THEN m4 / (m2 * m2) - 3 END AS kurtosis, "
        f"n_zero, n_out, {no_words}, n_total * {WIDTHS[t]} AS n_bytes FROM {whole}, {parts}"
    )


TYPED_COLUMNS = """
SELECT *, n_total - n_null AS nn,
  round(100.0 * n_null / n_total, 2) AS null_pct,
  CASE WHEN n_total > n_null THEN round(n_unique::DOUBLE / (n_total - n_null), 4)
       WHEN n_unique IS NULL THEN 0.0 ELSE 0.0 END AS unique_ratio,
  CASE WHEN kind = 'instant' THEN 'datetime'
       WHEN kind IN ('integer', 'real') AND n_unique <= 2 THEN 'boolean'
       WHEN kind IN ('integer', 'real') AND n_unique <= 15 THEN 'numeric_discrete'
       WHEN kind IN ('integer', 'real') THEN 'numeric_continuous'
       WHEN kind <> 'string' OR n_total = n_null THEN 'unknown'
       WHEN date_like THEN 'datetime'
       WHEN avg_length > 50 THEN 'text'
       WHEN n_unique <= 20 OR n_unique::DOUBLE / (n_total - n_null) < 0.05 THEN 'categorical_low'
       ELSE 'categorical_high' END AS inferred_type
FROM facts"""

PROFILED = """
SELECT *, inferred_type LIKE 'numeric_%' AS is_num,
  CASE WHEN inferred_type LIKE 'numeric_%' THEN CASE WHEN nn >= 10 THEN n_out ELSE 0 END END AS n_outliers,
  CASE WHEN inferred_type LIKE 'numeric_%' THEN CASE WHEN nn >= 10 THEN round(100.0 * n_out / nn, 2) ELSE 0.0 END END AS pct_outliers
FROM typed"""


def duplicates(names):
    parts = []
    for name in names:
        cs = ", ".join(c for c, _ in fields(name))
        parts.append(
            f"SELECT {quote(name)} AS dataset, (SELECT count(*) FROM {source(name)}) - "
            f"(SELECT count(*) FROM (SELECT DISTINCT {cs} FROM {source(name)})) AS n_duplicate_rows"
        )
    return union(parts)


TOTALS = """
SELECT t.dataset, max(n_total) AS n_rows, count(*) AS n_cols,
  round(100.0 * sum(n_null) / sum(n_total), 2) AS overall_null_pct,
  round(sum(n_bytes) / 1e6, 3) AS size_mb, max(n_duplicate_rows) AS n_duplicate_rows
FROM typed t JOIN dup USING (dataset) GROUP BY t.dataset"""


def profile_ctes(names, only=None):
    return (
        f"WITH facts AS ({column_facts(names, only)}), typed AS ({TYPED_COLUMNS}), profiled AS ({PROFILED}), "
        f"dup AS ({duplicates(names)}), totals AS ({TOTALS})"
    )


def top_lists(names):
    """Ten most frequent values of text and whole-number columns."""
    parts = []
    for name in names:
        for position, (c, t) in enumerate(fields(name)):
            if t in "sil":
                parts.append(
                    f"SELECT * FROM (SELECT {quote(name)} AS dataset, {position} AS position, {quote(c)} AS \"column\", "
                    f"row_number() OVER (ORDER BY n DESC, x)::INTEGER AS rank, x::VARCHAR AS value, n "
                    f"FROM (SELECT {c} AS x, count(*) AS n FROM {source(name)} WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rank <= 10"
                )
    return union(parts)


LISTED = ["orders", "events_holes", "documents", "labels", "part", "pages"]
numeric = lambda c, t: t in ("i", "l", "d")

# ---------------------------------------------------------------------- readiness


def requirement_rows(catalogue=REQUIREMENTS):
    rows = []
    for use, tiers in catalogue.items():
        entries = [(t, *e) for t in TIERS for e in tiers.get(t, [])]
        for no, (tier, text, weight, patterns) in enumerate(entries, 1):
            rows.append((quote(use), quote(tier), str(TIERS.index(tier)), str(no), quote(text), str(weight),
                         array([p.lower() for p in patterns])))
    return f"SELECT * FROM {values(rows, 'use_case, tier, tier_no, req_no, description, weight, patterns')}"


def uses(names, cases=None):
    rows = [(quote(d), quote(u)) for d in names for u in (cases or [*REQUIREMENTS, "sales_forecasting"])]
    return f"SELECT * FROM {values(rows, 'dataset, use_case')}"


def column_names(names):
    rows = [(quote(n), quote(c)) for n in names for c, _ in fields(n)]
    return f"SELECT * FROM {values(rows, 'dataset, col')}"


def match_ctes(names, cases=None, catalogue=REQUIREMENTS):
    return f"""uses AS ({uses(names, cases)}), req AS ({requirement_rows(catalogue)}), names AS ({column_names(names)}),
match AS (
  SELECT u.dataset, u.use_case, r.tier, r.tier_no, r.req_no, r.description, r.weight, min(lower(n.col)) AS matched_column
  FROM uses u JOIN req r USING (use_case)
  LEFT JOIN names n ON n.dataset = u.dataset AND len(list_filter(r.patterns, lambda p: contains(lower(n.col), p))) > 0
  GROUP BY ALL),
tiers AS (
  SELECT u.dataset, u.use_case, t.tier, t.tier_no,
    CASE WHEN sum(m.weight) > 0 THEN round(100.0 * sum(CASE WHEN m.matched_column IS NOT NULL THEN m.weight ELSE 0 END) / sum(m.weight), 1)
         ELSE 100.0 END AS score,
    coalesce(sum(CASE WHEN m.matched_column IS NOT NULL THEN m.weight ELSE 0 END), 0)::BIGINT AS earned,
    coalesce(sum(m.weight), 0)::BIGINT AS max_weight
  FROM uses u CROSS JOIN (VALUES ('critical', 0), ('important', 1), ('nice', 2)) t(tier, tier_no)
  LEFT JOIN match m ON m.dataset = u.dataset AND m.use_case = u.use_case AND m.tier = t.tier
  GROUP BY ALL),
raw AS (
  SELECT dataset, use_case,
    CASE WHEN sum(max_weight) > 0 THEN round(100.0 * sum(earned) / sum(max_weight), 1) ELSE 0.0 END AS raw_score
  FROM tiers GROUP BY ALL)"""


PENALTY = """
SELECT t.dataset,
  CASE WHEN overall_null_pct > 30 THEN 10.0 WHEN overall_null_pct > 15 THEN 6.0
       WHEN overall_null_pct > 8 THEN 3.0 WHEN overall_null_pct > 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS null_penalty,
  coalesce(o.n, 0)::DOUBLE AS outlier_penalty,
  CASE WHEN n_duplicate_rows::DOUBLE / n_rows > 0.05 THEN 5.0 WHEN n_duplicate_rows::DOUBLE / n_rows > 0.01 THEN 2.0 ELSE 0.0 END::DOUBLE AS duplicate_penalty
FROM totals t LEFT JOIN (SELECT dataset, count(*) FILTER (pct_outliers > 10) AS n FROM profiled GROUP BY 1) o USING (dataset)"""

SCORES = """
penalty AS (SELECT *, least(null_penalty + outlier_penalty + duplicate_penalty, 20.0) AS quality_penalty FROM penalty0),
scored AS (
  SELECT dataset, use_case, raw_score, quality_penalty, greatest(round(raw_score - quality_penalty, 1), 0.0) AS score
  FROM raw JOIN penalty USING (dataset)),
banded AS (
  SELECT *, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 60 THEN 'MODERATE' WHEN score >= 40 THEN 'LOW' ELSE 'VERY LOW' END AS band,
    '[' || repeat('█', round_even(score / 100 * 30, 0)::INTEGER) || repeat('░', 30 - round_even(score / 100 * 30, 0)::INTEGER)
      || '] ' || round_even(score, 0)::INTEGER || '%' AS bar
  FROM scored)"""


def readiness_ctes(names):
    return f"{profile_ctes(names)}, {match_ctes(names)}, penalty0 AS ({PENALTY}), {SCORES}"


RECOMMENDATIONS = """
recs0 AS (
  SELECT dataset, use_case, 1 AS section, req_no AS item, 'critical' AS severity,
    printf('No column for ''%s'' (critical, weight %d).', description, weight) AS text
  FROM match WHERE tier = 'critical' AND matched_column IS NULL
  UNION ALL
  SELECT dataset, use_case, 2, req_no, 'important', printf('No column for ''%s'' (important, weight %d).', description, weight)
  FROM match WHERE tier = 'important' AND matched_column IS NULL
  UNION ALL
  SELECT dataset, use_case, 3, 0, 'quality',
    printf('%.2f%% of the cells hold nothing.', overall_null_pct)
  FROM uses JOIN totals USING (dataset) WHERE overall_null_pct > 8
  UNION ALL
  SELECT dataset, use_case, 4, position, 'outliers',
    printf('%.2f%% of the values of ''%s'' lie outside its fences.', pct_outliers, "column")
  FROM uses JOIN profiled USING (dataset) WHERE pct_outliers > 5
  UNION ALL
  SELECT dataset, use_case, 5, 0, 'verdict',
    score || ' of 100 points after ' || quality_penalty || ' off for quality: ' || band || '.'
  FROM banded),
recs AS (
  SELECT dataset, use_case, row_number() OVER (PARTITION BY dataset, use_case ORDER BY section, item)::INTEGER AS seq, severity, text
  FROM recs0)"""

RISKS = """
risks0 AS (
  SELECT dataset, use_case, 1 AS section, 'HIGH' AS severity, 'Critical fields missing' AS risk,
    printf('%d critical field(s) not in the data', count(*)) AS detail,
    'See the list of missing fields' AS mitigation
  FROM match WHERE tier = 'critical' AND matched_column IS NULL GROUP BY ALL
  UNION ALL
  SELECT dataset, use_case, 2, 'HIGH', 'Many nulls', printf('%.2f%% of all values are null', overall_null_pct),
    'See the null share of each column'
  FROM uses JOIN totals USING (dataset) WHERE overall_null_pct > 15
  UNION ALL
  SELECT dataset, use_case, 3, CASE WHEN n_rows < 500 THEN 'HIGH' ELSE 'MEDIUM' END,
    CASE WHEN n_rows < 500 THEN 'Too few rows' ELSE 'Modest number of rows' END,
    printf('%d rows, under %d', n_rows, CASE WHEN n_rows < 500 THEN 500 ELSE 2000 END),
    CASE WHEN n_rows < 500 THEN 'Compare scores over several splits' ELSE 'Watch how scores vary with the split' END
  FROM uses JOIN totals USING (dataset) WHERE n_rows < 2000),
risks AS (
  SELECT dataset, use_case, row_number() OVER (PARTITION BY dataset, use_case ORDER BY section)::INTEGER AS seq,
    severity, risk, detail, mitigation FROM risks0)"""

# ----------------------------------------------------------------------- features

RETURNS_FEATURES = [c for c, _ in fields("returns") if c != "target"]
RETURNS_NUMBERS = "returns AS (SELECT * REPLACE ((dense_rank() OVER (ORDER BY l_linestatus) - 1) AS l_linestatus) FROM " + source("returns") + ")"


def correlation(a, b, table):
    return (
        f"(SELECT CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 "
        f"THEN covar_pop({a}::DOUBLE, {b}::DOUBLE) / (stddev_pop({a}::DOUBLE) * stddev_pop({b}::DOUBLE)) END FROM {table})"
    )


PAIRS = "pairs AS (" + union(
    [
        f"SELECT {quote(a)} AS feature_a, {quote(b)} AS feature_b, {correlation(a, b, 'returns')} AS r"
        for i, a in enumerate(RETURNS_FEATURES)
        for b in RETURNS_FEATURES[i + 1 :]
    ]
) + ")"


def bins(c, table):
    cuts = ", ".join(str(i / 10) for i in range(1, 10))
    return (
        f"(SELECT t.*, len(list_filter(list_distinct(e.cuts), lambda q: q < t.{c}))::INTEGER AS bin "
        f"FROM {table} t, (SELECT quantile_cont({c}::DOUBLE, [{cuts}]) AS cuts FROM {table}) e)"
    )


def binned_mi(name, c, table, y):
    """Plug-in mutual information of binned c with y, given as an expression."""
    return (
        f"SELECT {quote(name)} AS feature, greatest(sum(n / total * ln(n * total / (in_bin * in_class))), 0.0) AS mi_score FROM ("
        "SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS total, sum(n) OVER (PARTITION BY bin)::DOUBLE AS in_bin, "
        f"sum(n) OVER (PARTITION BY y)::DOUBLE AS in_class FROM (SELECT bin, {y} AS y, count(*) AS n FROM {bins(c, table)} GROUP BY 1, 2))"
    )


MI_BINNED = union([binned_mi(c, c, "returns", "target") for c in RETURNS_FEATURES])

PRICE_FEATURES = [c for c, _ in fields("prices") if c != "target"]
PRICES_CTE = (
    "prices AS (SELECT o_custkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus, "
    "dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority, half_price, target FROM "
    + source("prices") + "), prices_y AS (SELECT * RENAME (bin AS y_bin) FROM " + bins("target", "prices") + ")"
)


def digamma(n):
    z = f"({n} + 8)"
    steps = " + ".join(f"1.0 / ({n} + {i})" if i else f"1.0 / {n}" for i in range(8))
    return (
        f"(ln({z}) - 0.5 / {z} - 1.0 / 12 / pow({z}, 2) + 1.0 / 120 / pow({z}, 4) - 1.0 / 252 / pow({z}, 6) "
        f"+ 1.0 / 240 / pow({z}, 8) - ({steps}))"
    )


def knn_mi(c):
    """Nearest-neighbour score of one column by sorted order; k = 3."""
    return f"""SELECT {quote(c)} AS feature, round(greatest({digamma('any_value(n_all)')} + avg({digamma('3.0')}) - avg({digamma('n_class')}) - avg({digamma('m')}), 0.0), 4) AS mi_score
FROM (
  SELECT p.id, any_value(p.n_class) AS n_class, any_value(p.n_all) AS n_all, sum(e.sign * e.seen)::DOUBLE AS m
  FROM (SELECT *, sum(weight) OVER (ORDER BY spot, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
        FROM (
          SELECT id, x AS spot, 1 AS side, 1 AS weight, 0 AS sign FROM knn_{c}
          UNION ALL SELECT id, CASE WHEN near < x THEN near ELSE x - far END, CASE WHEN far = 0 THEN 0 ELSE 2 END, 0, -1 FROM knn_{c}
          UNION ALL SELECT id, CASE WHEN near > x THEN near ELSE x + far END, CASE WHEN far = 0 THEN 2 ELSE 0 END, 0, 1 FROM knn_{c})) e
  JOIN knn_{c} p ON p.id = e.id WHERE e.sign <> 0 GROUP BY p.id)"""


def knn_cte(c):
    steps = ", ".join(
        f"{{'far': x - lag(x, {j}) OVER w, 'near': lag(x, {j}) OVER w}}, {{'far': lead(x, {j}) OVER w - x, 'near': lead(x, {j}) OVER w}}"
        for j in (1, 2, 3)
    )
    return f"""knn0_{c} AS (
  SELECT id, target, x, count(*) OVER (PARTITION BY target)::DOUBLE AS n_class, count(*) OVER ()::DOUBLE AS n_all, [{steps}] AS steps
  FROM (SELECT row_number() OVER () AS id, target, {c} AS x FROM {source('returns')})
  WINDOW w AS (PARTITION BY target ORDER BY x, id)),
knn_{c} AS (
  SELECT id, x, n_class, n_all, s.far AS far, s.near AS near
  FROM (SELECT *, list_sort(list_filter(steps, lambda s: s.far IS NOT NULL))[3] AS s FROM knn0_{c}))"""


def plane_mi(table, key, columns, target, k=3):
    """Neighbour scores of number columns with a number target, from all distances between all rows."""
    word = lambda name, at: f"('0x' || substr(md5('jitter:{name}:' || row::VARCHAR), {at}, 8))::BIGINT::DOUBLE"
    normal = lambda name: f"sqrt(-2.0 * ln(({word(name, 1)} + 1.0) / (2.0 ** 32 + 1.0))) * cos(2.0 * pi() * ({word(name, 9)} / 2.0 ** 32))"
    deviation = lambda c: f"(CASE WHEN s.dev_{c} > 0 THEN s.dev_{c} ELSE 1.0 END)"
    scaled = lambda c: f"g.{c} / {deviation(c)} + 1e-10 * greatest(1.0, abs(s.mean_{c} / {deviation(c)})) * {normal(c)}"
    names = [*columns, target]
    shown = ", ".join(f"({sql})::DOUBLE AS {c}" for c, sql in {**columns, target: target}.items())
    stats = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS dev_{c}" for c in names)
    long = " UNION ALL ".join(f"SELECT {quote(c)} AS feature, row, {c} AS x, {target} AS y FROM jittered" for c in columns)
    return f"""WITH given AS (SELECT {key} AS row, {shown} FROM {table}), s AS (SELECT {stats} FROM given),
jittered AS (SELECT row, {', '.join(f'{scaled(c)} AS {c}' for c in names)} FROM given g, s),
long AS ({long}),
apart AS (SELECT a.feature, a.row, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, a.row <> b.row AS other
  FROM long a JOIN long b ON a.feature = b.feature),
reach AS (SELECT feature, row, min(greatest(dx, dy), {k}) FILTER (other) AS near FROM apart GROUP BY feature, row),
counted AS (SELECT a.feature, a.row, count(*) FILTER (dx < r.near[{k}]) AS mx, count(*) FILTER (dy < r.near[{k}]) AS my
  FROM apart a JOIN reach r ON r.feature = a.feature AND r.row = a.row GROUP BY a.feature, a.row),
psi AS (SELECT n, coalesce(sum(1.0 / n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329 AS v
  FROM (SELECT unnest(range(1, (SELECT count(*) + 2 FROM given))) AS n)),
scored AS (SELECT feature, round(greatest((SELECT v FROM psi WHERE n = (SELECT count(*) FROM given)) + (SELECT v FROM psi WHERE n = {k})
    - avg(px.v) - avg(py.v), 0.0), 5) AS mi_score
  FROM counted JOIN psi px ON px.n = mx JOIN psi py ON py.n = my GROUP BY feature)
SELECT feature, mi_score, row_number() OVER (ORDER BY mi_score DESC, feature)::INTEGER AS rank FROM scored"""


def numeric_advice(name):
    """Suggestions per numeric column, as a list in rule order."""
    whole = [c for c, t in fields(name) if t in ("i", "l")]
    is_whole = " OR ".join(f"\"column\" = {quote(c)}" for c in whole) or "FALSE"
    return f"""SELECT dataset, "column", list_filter([
  CASE WHEN abs(skewness) > 1.5 AND mn >= 0 THEN printf('log transform (skewness %.2f)', skewness) END,
  CASE WHEN ({is_whole}) AND n_null = 0 AND n_unique <= 10 THEN 'treat as category, one-hot encode' END,
  CASE WHEN 100.0 * n_zero / nn > 30 THEN printf('add a zero flag (%.0f%% zeros)', 100.0 * n_zero / nn) END,
  CASE WHEN mx > 1000 AND CASE WHEN mean = 0 THEN std > 0 ELSE std / mean > 2 END THEN 'standardise (wide spread)' END
], lambda s: s IS NOT NULL) AS suggestions, position FROM typed WHERE dataset = {quote(name)} AND kind IN ('integer', 'real') AND nn >= 10"""


CATEGORY_ADVICE = """SELECT dataset, "column", [CASE WHEN n_unique = 2 THEN 'encode as 0/1'
  WHEN n_unique <= 10 THEN printf('one-hot encode (%d categories)', n_unique)
  WHEN n_unique <= 50 THEN 'target or frequency encode' ELSE 'hash or embed (very many values)' END] AS suggestions, position
FROM typed WHERE kind = 'string'"""

ADVISED = ["returns", "events_holes", "lineitem_holes", "part"]


def advice_ctes(names):
    ctes = f"facts AS ({column_facts(names, lambda c, t: t in 'ilds')}), typed AS ({TYPED_COLUMNS})"
    return f"{ctes}, advice1 AS ({union([numeric_advice(n) for n in names])}), advice2 AS ({CATEGORY_ADVICE})"


def unnested(cte):
    return (
        f"SELECT dataset, \"column\", i::INTEGER AS seq, suggestions[i + 1] AS suggestion "
        f"FROM (SELECT *, unnest(range(len(suggestions))) AS i FROM {cte})"
    )


# ------------------------------------------------------------------------- models


def model_rows():
    rows = []
    for i, (key, name, _, task, tags, poc, prod, *_rest, reason) in enumerate(MODELS):
        rows.append((quote(key), quote(name), quote(task), array(tags), str(poc), str(prod),
                     quote(reason) if reason else "NULL", str(i)))
    return f"SELECT * FROM {values(rows, 'model_key, model_name, task, tags, poc_days, production_days, reason, pos')}"


def first_label(names):
    found = []
    for n in names:
        named = [c for c, _ in fields(n) if any(w in c.lower() for w in ("churn", "target", "label"))]
        if named:
            found.append((n, named[0]))
    return found


def balance(names):
    parts = [
        f"SELECT {quote(n)} AS dataset, CASE WHEN count(*) < 2 OR "
        f"(SELECT inferred_type FROM typed WHERE dataset = {quote(n)} AND \"column\" = {quote(c)}) NOT IN "
        "('boolean', 'categorical_low', 'categorical_high') THEN 'unknown' "
        "WHEN min(n)::DOUBLE / max(n) > 0.3 THEN 'balanced' ELSE 'imbalanced' END AS class_balance FROM "
        f"(SELECT count(*) AS n FROM {source(n)} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 10)"
        for n, c in first_label(names)
    ]
    return union(parts) if parts else "SELECT '' AS dataset, '' AS class_balance WHERE FALSE"


def model_ctes(names=MODEL_DATA):
    return f"""{readiness_ctes(names)}, {RETURNS_NUMBERS}, {PAIRS},
balance AS ({balance(names)}), models AS ({model_rows()}),
traits AS (
  SELECT b.dataset, b.use_case, t.n_rows,
    CASE WHEN n_rows > 50000 THEN 'large' WHEN n_rows > 5000 THEN 'medium' ELSE 'small' END AS data_size,
    coalesce(class_balance, 'unknown') AS class_balance, k.has_categoricals, k.n_numeric_features,
    CASE WHEN b.dataset = 'returns' THEN (SELECT count(*) FROM pairs WHERE abs(r) >= 0.85) ELSE 0 END AS n_high_corr_pairs,
    t.overall_null_pct AS null_pct, b.score AS readiness_score
  FROM banded b JOIN totals t USING (dataset)
  JOIN (SELECT dataset, count(*) FILTER (inferred_type LIKE 'categorical_%') > 0 AS has_categoricals,
          count(*) FILTER (inferred_type LIKE 'numeric_%') AS n_numeric_features FROM typed GROUP BY 1) k USING (dataset)
  LEFT JOIN balance USING (dataset)),
points AS (
  SELECT t.*, m.*,
    CASE data_size
      WHEN 'large' THEN CASE WHEN list_contains(tags, 'large-data') THEN 20 WHEN list_contains(tags, 'medium-data') THEN 10 ELSE 0 END
      WHEN 'medium' THEN CASE WHEN list_has_any(tags, ['medium-data', 'tabular']) THEN 20 ELSE 0 END + CASE WHEN list_contains(tags, 'large-data') THEN 5 ELSE 0 END
      ELSE CASE WHEN list_has_any(tags, ['baseline', 'interpretable']) THEN 20 ELSE 0 END - CASE WHEN list_has_any(tags, ['large-data', 'deep-learning']) THEN 10 ELSE 0 END
    END
    + CASE WHEN has_categoricals AND model_key IN ('xgboost_classifier', 'lightgbm_classifier', 'xgboost_regressor') THEN 10 ELSE 0 END
    + CASE WHEN class_balance = 'imbalanced' AND model_key IN ('xgboost_classifier', 'lightgbm_classifier') THEN 10 ELSE 0 END
    - CASE WHEN n_high_corr_pairs > 3 AND model_key IN ('logistic_regression', 'linear_regression_ridge') THEN 5 ELSE 0 END
    + CASE WHEN model_key IN ('logistic_regression', 'linear_regression_ridge') THEN 5 ELSE 0 END
    + CASE WHEN use_case = 'churn_prediction' AND model_key = 'xgboost_classifier' THEN 10
           WHEN use_case = 'fraud_detection' AND model_key = 'lightgbm_classifier' THEN 10 ELSE 0 END AS points
  FROM traits t, models m),
ranked AS (
  SELECT dataset, use_case, task, model_key, model_name, points::INTEGER AS score, poc_days, production_days,
    row_number() OVER (PARTITION BY dataset, use_case, task ORDER BY points DESC, pos)::INTEGER AS rank,
    coalesce(replace(reason, '{{size}}', data_size), printf('Data is %s, classes %s.', data_size, class_balance)) AS rationale
  FROM points),
strategy AS (
  SELECT t.dataset, t.use_case, r.model_key AS primary_model, r.model_name AS primary_name,
    CASE WHEN n_rows < 1000 THEN '5-fold cross-validation' WHEN n_rows < 10000 THEN 'stratified 70/15/15 split'
         ELSE '80/10/10 split, by time if there is one' END AS training,
    CASE WHEN n_rows < 1000 THEN 'under 1000 rows' WHEN n_rows < 10000 THEN '1000 to 9999 rows' ELSE '10000 rows or more' END AS training_reason,
    CASE WHEN n_rows < 1000 THEN '80/20 stratified' WHEN n_rows < 10000 THEN '70/15/15 stratified' ELSE '80/10/10' END AS train_split,
    'AUC-ROC' AS primary_metric,
    CASE WHEN class_balance = 'imbalanced' THEN 'macro F1, precision-recall curve, Cohen''s kappa' ELSE 'F1, precision, recall' END AS secondary_metrics,
    'class balance: ' || class_balance AS metric_note,
    CASE WHEN class_balance = 'imbalanced' THEN 'tune on validation rows' ELSE '0.5' END AS threshold,
    r.poc_days, r.production_days
  FROM traits t LEFT JOIN ranked r ON r.dataset = t.dataset AND r.use_case = t.use_case AND r.task = 'classification' AND r.rank = 1)"""


# ------------------------------------------------------------------------ reports

TITLE = (
    "CASE use_case " + " ".join(f"WHEN {quote(u)} THEN {quote(u.replace('_', ' ').title())}"
                               for u in [*REQUIREMENTS, "sales_forecasting"]) + " END"
)


def warnings_sql():
    return """warned AS (
  SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY section, item)::INTEGER AS seq, "column", kind, message FROM (
    SELECT dataset, 1 AS section, position AS item, "column", 'unprofiled' AS kind,
      printf('Column ''%s'' of type %s has null counts only', "column", dtype) AS message FROM typed WHERE kind = 'other'
    UNION ALL
    SELECT dataset, 2, position, "column", 'high_nulls', printf('Column ''%s'' is %.2f%% null', "column", null_pct) FROM typed WHERE null_pct > 20
    UNION ALL
    SELECT dataset, 3, 0, NULL, 'duplicates',
      printf('%d duplicate rows (%.1f%%)', n_duplicate_rows, round(100.0 * n_duplicate_rows / n_rows, 1)) FROM totals WHERE n_duplicate_rows > 0))"""


def listed(table, order, text, name, keys="dataset"):
    return f"(SELECT {keys}, list({text} ORDER BY {order}) AS {name} FROM {table} GROUP BY ALL)"


def report_ctes():
    keys = "dataset, use_case"
    missing = lambda tier: f"(SELECT {keys}, list(description ORDER BY req_no) AS missing_{tier} FROM match WHERE tier = '{tier}' AND matched_column IS NULL GROUP BY ALL)"
    mi_rank = f"SELECT 'returns' AS dataset, feature, row_number() OVER (ORDER BY mi_score DESC, feature) AS rank FROM ({MI_BINNED})"
    adv = (
        f"SELECT dataset, 1 AS section, position, \"column\" || ': ' || array_to_string(suggestions, ', ') AS line FROM ({numeric_advice('returns')}) WHERE len(suggestions) > 0 "
        f"UNION ALL SELECT dataset, 2, position, \"column\" || ': ' || array_to_string(suggestions, ', ') FROM ({CATEGORY_ADVICE}) WHERE dataset = 'returns'"
    )
    top = "ranked WHERE task = 'classification' AND rank <= 3"
    return f"""{model_ctes()}, {warnings_sql()}, {RECOMMENDATIONS}, {RISKS}, mi AS ({mi_rank}), adv AS ({adv}),
facts_ AS (
  SELECT b.dataset, b.use_case, b.raw_score, b.quality_penalty, b.score, b.band, b.bar, t.n_rows, t.n_cols, t.size_mb, t.overall_null_pct,
    CASE WHEN b.dataset = 'returns' THEN (SELECT count(*) FROM pairs WHERE abs(r) >= 0.85) ELSE 0 END AS n_pairs,
    coalesce(w.warnings, []) AS warnings, ty.types, coalesce(f.features, []) AS features, coalesce(a.advice, []) AS advice,
    coalesce(mc.missing_critical, []) AS missing_critical, coalesce(mi_.missing_important, []) AS missing_important,
    r.recommendations, coalesce(k.risks, []) AS risks, coalesce(k2.risk_names, []) AS risk_names, m.models, m2.model_lines, s.*
  FROM banded b JOIN totals t USING (dataset) JOIN strategy s USING (dataset, use_case)
  LEFT JOIN {listed('warned', 'seq', 'message', 'warnings')} w USING (dataset)
  LEFT JOIN (SELECT dataset, list(printf('"%s": %d', inferred_type, n) ORDER BY inferred_type) AS types
             FROM (SELECT dataset, inferred_type, count(*) AS n FROM typed GROUP BY ALL) GROUP BY 1) ty USING (dataset)
  LEFT JOIN {listed('mi', 'rank', 'feature', 'features')} f USING (dataset)
  LEFT JOIN {listed('adv', 'section, position', 'line', 'advice')} a USING (dataset)
  LEFT JOIN {missing('critical')} mc USING (dataset, use_case)
  LEFT JOIN {missing('important')} mi_ USING (dataset, use_case)
  LEFT JOIN {listed('recs', 'seq', 'text', 'recommendations', keys)} r USING (dataset, use_case)
  LEFT JOIN {listed('risks', 'seq', "printf('**%s**: %s — %s', severity, risk, detail)", 'risks', keys)} k USING (dataset, use_case)
  LEFT JOIN {listed('risks', 'seq', "printf('%s: %s', severity, risk)", 'risk_names', keys)} k2 USING (dataset, use_case)
  LEFT JOIN {listed(top, 'rank', 'model_name', 'models', keys)} m USING (dataset, use_case)
  LEFT JOIN {listed(top, 'rank', "printf('- **%s** — %s', model_name, rationale)", 'model_lines', keys)} m2 USING (dataset, use_case)),
told AS (
  SELECT *, {TITLE} || ', ' || dataset || ': ' || score || ' of 100 (' || band || ') on ' || format('{{:,}}', n_rows) || ' rows of '
      || n_cols || ' columns.' AS executive_summary,
    'Fields earn ' || raw_score || ' points, quality takes off ' || quality_penalty || ' (' || overall_null_pct || '% of cells null); '
      || CASE WHEN len(missing_critical) = 0 THEN 'every critical field has a column'
              ELSE 'critical fields without a column: ' || array_to_string(missing_critical, ', ') END || '.' AS assessment,
    warnings[1:3] || ['columns by type: ' || array_to_string(types, ', ')]
      || CASE WHEN n_pairs > 0 THEN [n_pairs || ' pair(s) of columns nearly repeat each other'] ELSE [] END
      || CASE WHEN len(features) > 0 THEN ['tells most of the target: ' || features[1]] ELSE [] END AS findings,
    list_transform(missing_important, lambda x: 'a column for ''' || x || ''' would add points')
      || CASE WHEN poc_days IS NOT NULL THEN [primary_name || ': about ' || poc_days || ' day(s) to a trial'] ELSE [] END AS opportunities,
    list_transform(missing_critical, lambda x: 'load a column for ''' || x || '''') || list_transform(advice[1:5], lambda x: 'reshape ' || x)
      || CASE WHEN primary_name IS NOT NULL THEN ['fit ' || primary_name || ' by ' || training || ', compare ' || primary_metric] ELSE [] END AS next_steps
  FROM facts_)"""


def bullets(items):
    return f"CASE WHEN len({items}) = 0 THEN '- none' ELSE array_to_string(list_transform({items}, lambda x: '- ' || x), chr(10)) END"


def or_word(items, separator, word):
    return f"CASE WHEN len({items}) = 0 THEN {quote(word)} ELSE array_to_string({items}, {quote(separator)}) END"


MARKDOWN = " || chr(10) || ".join(
    [
        f"'# Discovery report: ' || {TITLE}",
        "chr(10) || '## Summary'",
        "executive_summary",
        "chr(10) || '## Findings'",
        bullets("findings"),
        "chr(10) || '## Dataset' || chr(10) || '| Metric | Value |' || chr(10) || '|---|---|'",
        "'| Rows | ' || format('{:,}', n_rows) || ' |'",
        "'| Columns | ' || n_cols || ' |'",
        "'| Null rate | ' || overall_null_pct || '% |'",
        "'| Readiness | ' || score || '/100 (' || band || ') |'",
        "'| Bar | ' || bar || ' |'",
        "chr(10) || '## Gaps'",
        f"'**Missing critical fields:** ' || {or_word('missing_critical', ', ', 'none')} || chr(10)",
        "'**Recommendations:**'",
        bullets("recommendations"),
        "chr(10) || '**Risks:**'",
        bullets("risks"),
        "chr(10) || '## Features'",
        f"'**Best features:** ' || {or_word('features[1:6]', ', ', 'N/A')} || chr(10)",
        "'**Highly correlated pairs:** ' || n_pairs || chr(10)",
        "'**Advice:**'",
        bullets("advice[1:5]"),
        "chr(10) || '## Models'",
        "array_to_string(model_lines, chr(10))",
        "chr(10) || '**Training:** ' || training || ' — ' || training_reason",
        "chr(10) || '**Evaluation:** ' || primary_metric || ', then ' || secondary_metrics",
        "chr(10) || '## Next steps'",
        "CASE WHEN len(next_steps) = 0 THEN '- none' ELSE array_to_string(list_transform(range(1, len(next_steps) + 1), lambda i: i || '. ' || next_steps[i]), chr(10)) END",
    ]
)
PROMPT = " || chr(10) || ".join(
    [
        "'Report on a dataset examined for ' || use_case || ' (classification).'",
        "chr(10) || 'Profile'",
        "'rows: ' || n_rows || '; columns: ' || n_cols || '; null: ' || overall_null_pct || '%; size: ' || size_mb || ' MB'",
        "'types: {' || array_to_string(types, ', ') || '}'",
        f"'warnings: ' || {or_word('warnings', '; ', 'None')}",
        "chr(10) || 'Readiness'",
        "'score: ' || score || '/100'",
        f"'missing critical: ' || {or_word('missing_critical', ', ', 'None')}",
        f"'missing important: ' || {or_word('missing_important', ', ', 'None')}",
        f"'recommendations: ' || {or_word('recommendations[1:5]', '; ', 'None')}",
        f"'risks: ' || {or_word('risk_names', '; ', 'None')}",
        "chr(10) || 'Features'",
        f"'best: ' || {or_word('features[1:6]', ', ', 'N/A')}",
        "'highly correlated pairs: ' || n_pairs",
        f"'advice: ' || {or_word('advice[1:5]', '; ', 'None')}",
        "chr(10) || 'Models'",
        "'first: ' || primary_model",
        f"'best three: ' || {or_word('models', ', ', 'None')}",
        "'training: ' || training || '; metric: ' || primary_metric",
        "chr(10) || 'Answer with one JSON object with the text keys executive_summary, data_readiness_assessment, full_report "
        "and the list keys key_findings, top_opportunities, recommended_next_steps. Quote numbers from above.'",
    ]
)
MINIMAL = " || chr(10) || ".join(
    [
        f"'# Discovery report: ' || {TITLE}",
        f"chr(10) || '_{GENERATED_AT}_' || chr(10) || chr(10) || '## Dataset'",
        "'- Rows: ' || format('{:,}', n_rows)",
        "'- Columns: ' || n_cols",
        "'- Null rate: ' || overall_null_pct || '%'",
        "chr(10) || '## Readiness'",
        "'- Score: ' || score || '/100'",
        "'- ' || bar",
        "chr(10) || '## First model' || chr(10) || '- N/A'",
        "chr(10) || '## Run status'",
        "'- profile: success' || chr(10) || '- readiness: success' || chr(10) || '- features: error: out of reach'",
    ]
)

# ------------------------------------------------------------------------ samples


def uniform(salt, number):
    """The number-th draw of a row: eight digits of a digest of its id."""
    digest = f"md5('42:{salt}:{number // 4}:' || id)"
    return f"(('0x' || substr({digest}, {1 + 8 * (number % 4)}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def one_of(u, items):
    return f"{array(items)}[1 + floor({u} * {len(items)})::INTEGER]"


CHURN = f"""
WITH ids AS (SELECT c_custkey + 1 AS id FROM customer),
drawn AS (SELECT id, (18 + floor({uniform('churn', 0)} * 57))::INTEGER AS age, (1 + floor({uniform('churn', 1)} * 71))::INTEGER AS tenure_months,
  round(20.0::DOUBLE + {uniform('churn', 2)} * 100.0::DOUBLE, 2) AS monthly_charge, {uniform('churn', 3)} AS u_total,
  (1 + floor({uniform('churn', 4)} * 5))::INTEGER AS num_products, floor({uniform('churn', 5)} * 15)::INTEGER AS support_calls,
  {uniform('churn', 6)} AS u_churn, {uniform('churn', 7)} AS u_null FROM ids),
ranked AS (SELECT *, row_number() OVER (ORDER BY u_null, id) AS place, count(*) OVER () AS n FROM drawn)
SELECT printf('CUST-%05d', id) AS customer_id, age, tenure_months, monthly_charge,
  CASE WHEN place > floor(n * 0.02) THEN round(monthly_charge * tenure_months * (0.9::DOUBLE + u_total * 0.2::DOUBLE), 2) END AS total_charges,
  num_products, support_calls,
  (u_churn < least(greatest(0.05::DOUBLE + CASE WHEN tenure_months < 12 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN support_calls > 5 THEN 0.2::DOUBLE ELSE 0 END
    - CASE WHEN num_products > 3 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN monthly_charge > 80 THEN 0.1::DOUBLE ELSE 0 END, 0.02), 0.85))::INTEGER AS churn
FROM ranked"""

MERCHANTS = ["grocery", "gas_station", "restaurant", "online_retail", "travel", "entertainment", "healthcare", "atm"]
FRAUD = f"""
WITH ids AS (SELECT o_orderkey + 1 AS id FROM orders),
drawn AS (SELECT printf('TXN-%07d', id) AS transaction_id,
  least(greatest(round(-ln(1.0::DOUBLE - {uniform('fraud', 0)}) * 80.0::DOUBLE, 2), 0.5), 5000.0) AS amount,
  {one_of(uniform('fraud', 1), MERCHANTS)} AS merchant_category,
  round({uniform('fraud', 2)} * 24.0::DOUBLE, 2) AS time_of_day, round(-ln(1.0::DOUBLE - {uniform('fraud', 3)}) * 15.0::DOUBLE, 2) AS distance_from_home,
  {uniform('fraud', 4)} AS u_fraud FROM ids)
SELECT transaction_id, amount, merchant_category, time_of_day, distance_from_home,
  (u_fraud < least(greatest(0.02::DOUBLE + CASE WHEN amount > 500 THEN 0.15::DOUBLE ELSE 0 END
    + CASE WHEN time_of_day < 5 OR time_of_day > 22 THEN 0.10::DOUBLE ELSE 0 END
    + CASE WHEN distance_from_home > 50 THEN 0.15::DOUBLE ELSE 0 END, 0.01), 0.60))::INTEGER AS is_fraud
FROM drawn"""

CATEGORIES = ["Electronics", "Clothing", "Home & Garden", "Sports", "Books", "Food & Beverage"]
SALES = f"""
WITH ids AS (SELECT event_id + 1 AS id FROM events),
drawn AS (SELECT id, floor({uniform('sales', 0)} * 365)::INTEGER AS day, {one_of(uniform('sales', 1), CATEGORIES)} AS category,
  (1 + floor({uniform('sales', 2)} * 5))::INTEGER AS product, round(5.0::DOUBLE + {uniform('sales', 3)} * 495.0::DOUBLE, 2) AS unit_price,
  (1 + floor({uniform('sales', 4)} * 199))::INTEGER AS units, {one_of(uniform('sales', 5), ['North', 'South', 'East', 'West', 'Central'])} AS region FROM ids),
days AS (SELECT row_number() OVER (ORDER BY day) AS place, DATE '2023-01-01' + day AS on_day FROM drawn),
placed AS (SELECT *, row_number() OVER (ORDER BY id) AS place FROM drawn),
sold AS (SELECT p.*, on_day, floor(units * CASE WHEN month(on_day) IN (11, 12) THEN 1.4::DOUBLE ELSE 1.0 END)::INTEGER AS units_sold FROM placed p JOIN days USING (place))
SELECT strftime(on_day, '%Y-%m-%d') AS date, printf('%s-%03d', upper(category[1:3]), product) AS product_id, category, units_sold,
  unit_price, region, round(unit_price * units_sold, 2) AS revenue FROM sold"""

# ------------------------------------------------------------------------ replies

RESPONSE = f"""
WITH r AS (SELECT conv_id, turn, {REPLY} AS reply FROM conversations),
found AS (SELECT *, regexp_extract(reply, '(\\{{[\\s\\S]*\\}})', 1) AS whole, regexp_extract(reply, '```(?:json)?\\s*([\\s\\S]*?)```', 1) AS fenced FROM r),
parsed AS (SELECT *, CASE WHEN json_valid(whole) THEN whole::JSON WHEN json_valid(fenced) THEN fenced::JSON END AS j FROM found)
SELECT conv_id, turn, j IS NOT NULL AS parsed,
  CASE WHEN j IS NULL THEN substr(reply, 1, 500) ELSE coalesce(j->>'executive_summary', '') END AS executive_summary,
  CASE WHEN j IS NULL THEN 'See the full report' WHEN json_type(j->'key_findings') = 'ARRAY' THEN array_to_string((j->'key_findings')::VARCHAR[], '|') ELSE coalesce(j->>'key_findings', '') END AS key_findings,
  CASE WHEN j IS NULL THEN '' ELSE coalesce(j->>'data_readiness_assessment', '') END AS data_readiness_assessment,
  CASE WHEN j IS NULL THEN '' WHEN json_type(j->'top_opportunities') = 'ARRAY' THEN array_to_string((j->'top_opportunities')::VARCHAR[], '|') ELSE coalesce(j->>'top_opportunities', '') END AS top_opportunities,
  CASE WHEN j IS NULL THEN '' WHEN json_type(j->'recommended_next_steps') = 'ARRAY' THEN array_to_string((j->'recommended_next_steps')::VARCHAR[], '|') ELSE coalesce(j->>'recommended_next_steps', '') END AS recommended_next_steps,
  CASE WHEN j IS NULL THEN reply ELSE coalesce(j->>'full_report', '') END AS full_report
FROM parsed"""


def stats(names, columns, only=numeric):
    return f"WITH facts AS ({column_facts(names, only)}) SELECT dataset, \"column\", {columns} FROM facts"


def both(names, select):
    return f"WITH facts AS ({column_facts(names)}), typed AS ({TYPED_COLUMNS}) {select}"


LISTS = (
    f"SELECT l.* FROM ({top_lists(LISTED)}) l SEMI JOIN (SELECT * FROM typed WHERE inferred_type IN "
    "('boolean', 'categorical_low', 'categorical_high')) t "
    'ON t.dataset = l.dataset AND t."column" = l."column"'
)
FENCED = ["lineitem", "orders", "events_holes", "documents"]
COVERED = union(
    [
        f"SELECT {quote(d)} AS dataset, \"column\" FROM {values([(quote(c),) for c in names], chr(34) + 'column' + chr(34))}"
        for d, names in EXPECTED.items()
    ]
)
COVERAGE = f"""WITH facts AS ({column_facts(list(EXPECTED))}), wanted AS ({COVERED}),
covered AS (SELECT coalesce(w.dataset, f.dataset) AS dataset, coalesce(w."column", f."column") AS "column",
  CASE WHEN f."column" IS NULL THEN 'missing' WHEN w."column" IS NULL THEN 'extra' ELSE 'present' END AS status, n_total - n_null AS n_values
  FROM wanted w FULL OUTER JOIN facts f ON w.dataset = f.dataset AND w."column" = f."column")"""
SOURCE_ORDER = values([(quote(s), str(i)) for i, s in enumerate(SOURCES)], "dataset, pos")

ORACLES = {
    "profile_nulls": both(["events_holes", "lineitem_holes", "events_sparse"],
        'SELECT dataset, position, "column", n_total, n_null, null_pct, unique_ratio FROM typed'),
    "profile_distinct": f"WITH facts AS ({column_facts(['lineitem', 'orders', 'documents', 'pages', 'events_holes'])}) "
        'SELECT dataset, "column", n_total, n_unique FROM facts',
    "profile_distinct_approx": f"WITH facts AS ({column_facts(['lineitem', 'events_holes'])}) "
        'SELECT dataset, "column", CASE WHEN n_unique <= 50 THEN n_unique END AS small_count, TRUE AS is_near FROM facts',
    "profile_types": both(TYPED, 'SELECT dataset, position, "column", inferred_type, n_unique FROM typed'),
    "profile_numeric": stats(["lineitem", "events_holes"],
        "round(mn, 4) AS min, round(mx, 4) AS max, round(mean, 4) AS mean, round(median, 4) AS median, "
        "round(std, 4) AS std, round(skewness, 4) AS skewness, round(kurtosis, 4) AS kurtosis"),
    "profile_quartiles": stats(FENCED,
        "round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, "
        "round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence"),
    "profile_infinite": f"""WITH e AS {source('events_infinite')},
        q AS (SELECT quantile_cont(spoilt, 0.25) AS q1, quantile_cont(spoilt, 0.5) AS median, quantile_cont(spoilt, 0.75) AS q3 FROM e)
        SELECT "column", n_total, mn AS min, mx AS max, round(median, 4) AS median, round(q1, 4) AS q1, round(q3, 4) AS q3,
          n_out AS n_outliers, round(mean, 4) AS mean, round(std, 4) AS std, round(skewness, 4) AS skewness
        FROM ({column_facts(['events_infinite'])})
        UNION ALL SELECT 'spoilt', count(*), min(spoilt), max(spoilt), round(any_value(median), 4), round(any_value(q1), 4), round(any_value(q3), 4),
          count(*) FILTER (spoilt < q1 - 1.5 * (q3 - q1) OR spoilt > q3 + 1.5 * (q3 - q1)), 'Infinity'::DOUBLE, NULL, NULL FROM e, q""",
    "outliers_iqr": stats(FENCED, "n_out AS n_outliers, round(100.0 * n_out / (n_total - n_null), 2) AS pct_outliers"),
    "top_values": both(LISTED, f'SELECT dataset, "column", rank, value, n FROM ({LISTS})'),
    "column_mode": both(LISTED, f'SELECT dataset, "column", value AS mode FROM ({LISTS}) WHERE rank = 1'),
    "date_range": f"""WITH facts AS ({column_facts(['orders', 'events_holes', 'lineitem_holes', 'orders_text_dates'],
        lambda c, t: c in ('o_orderdate', 'o_day_first', 'o_month_name', 'ts', 'l_shipdate'))}) SELECT dataset, "column", date_min, date_max FROM facts""",
    "date_spellings": f"""WITH facts AS ({column_facts(['orders_written_dates', 'orders_text_dates'], lambda c, t: t == 's')})
        SELECT dataset, "column", date_like, CASE WHEN date_like THEN date_min END AS date_min,
        CASE WHEN date_like THEN date_max END AS date_max FROM facts""",
    "column_profile": f"""{profile_ctes(['orders', 'events_holes', 'labels'])},
        tops AS ({top_lists(['orders', 'events_holes', 'labels'])})
        SELECT p.dataset, p.position, p."column", dtype, inferred_type, n_total, n_null, null_pct, n_unique, unique_ratio,
        CASE WHEN is_num THEN round(mn, 4) END AS min, CASE WHEN is_num THEN round(mx, 4) END AS max,
        CASE WHEN is_num THEN round(mean, 4) END AS mean, CASE WHEN is_num THEN round(median, 4) END AS median,
        CASE WHEN is_num THEN round(std, 4) END AS std, CASE WHEN is_num THEN round(skewness, 4) END AS skewness,
        CASE WHEN is_num THEN round(kurtosis, 4) END AS kurtosis, CASE WHEN is_num THEN round(q1, 4) END AS q1,
        CASE WHEN is_num THEN round(q3, 4) END AS q3, n_outliers, pct_outliers,
        CASE WHEN inferred_type IN ('boolean', 'categorical_low', 'categorical_high') THEN t.value END AS mode,
        CASE WHEN inferred_type = 'datetime' THEN date_min END AS date_min, CASE WHEN inferred_type = 'datetime' THEN date_max END AS date_max
        FROM profiled p LEFT JOIN tops t ON t.dataset = p.dataset AND t.position = p.position AND t.rank = 1""",
    "dataset_summary": f"""{profile_ctes(['events_holes', 'lineitem_holes', 'documents', 'embeddings'])}
        SELECT dataset, n_rows, n_cols, overall_null_pct, size_mb FROM totals""",
    "duplicate_rows": duplicates(["lineitem", "lineitem_flags", "documents_text", "events_sparse", "embeddings"]),
    "profile_warnings": f"""{profile_ctes(['events_holes', 'events_sparse', 'lineitem_flags', 'embeddings', 'documents_text'])},
        {warnings_sql()} SELECT * FROM warned""",
    "type_distribution": both(TYPED, "SELECT dataset, inferred_type, count(*) AS n_columns FROM typed GROUP BY ALL"),
    "schema_coverage": f"{COVERAGE} SELECT * FROM covered",
    "coverage_summary": f"""{COVERAGE} SELECT dataset, count(*) FILTER (status <> 'extra') AS expected_columns,
        count(*) FILTER (status = 'present') AS present_columns, count(*) FILTER (status = 'missing') AS missing_columns,
        count(*) FILTER (status = 'extra') AS extra_columns,
        round(100.0 * count(*) FILTER (status = 'present') / count(*) FILTER (status <> 'extra'), 1) AS coverage_pct FROM covered GROUP BY 1""",
    "source_profiles": f"""{profile_ctes(SOURCES)} SELECT 'combined' AS dataset, sum(n_rows)::BIGINT AS n_rows, sum(n_cols)::BIGINT AS n_cols,
        sum(n_duplicate_rows)::BIGINT AS n_duplicate_rows, (SELECT round(100.0 * sum(n_null) / sum(n_total), 2) FROM typed) AS overall_null_pct,
        TRUE AS multi_source FROM totals""",
    "source_relationships": f"""WITH facts AS ({column_facts(SOURCES)}), named AS (SELECT f.*, o.pos FROM facts f JOIN {SOURCE_ORDER} ON v.dataset = f.dataset)
        SELECT a.dataset AS source_a, b.dataset AS source_b, string_agg(a."column", ',' ORDER BY a."column") AS shared_columns,
        min(a."column") AS likely_join_key, max(a.n_total) AS rows_a, max(b.n_total) AS rows_b
        FROM named a JOIN named b ON a."column" = b."column" AND a.pos < b.pos GROUP BY 1, 2""".replace("o.pos", "v.pos"),
    "readiness_match": f"""WITH facts AS ({column_facts(LIBRARY)}), {match_ctes(LIBRARY)}
        SELECT m.*, f.n_total - f.n_null AS n_values FROM match m LEFT JOIN facts f ON f.dataset = m.dataset AND lower(f."column") = m.matched_column""",
    "readiness_custom": f"""WITH {match_ctes(['orders', 'lineitem_holes', 'events_holes'], list(OWN_REQUIREMENTS), OWN_REQUIREMENTS)} SELECT * FROM tiers""",
    "readiness_tiers": f"WITH {match_ctes(LIBRARY)} SELECT * FROM tiers",
    "readiness_score": f"{readiness_ctes(LIBRARY)} SELECT dataset, use_case, raw_score, quality_penalty, score, band FROM banded",
    "readiness_bar": f"{readiness_ctes(LIBRARY)} SELECT dataset, use_case, bar FROM banded",
    "readiness_gaps": f"""WITH {match_ctes(LIBRARY)} SELECT u.dataset, u.use_case,
        coalesce(string_agg(description, '|' ORDER BY req_no) FILTER (matched_column IS NOT NULL), '') AS present_fields,
        {", ".join(f"coalesce(string_agg(description, '|' ORDER BY req_no) FILTER (matched_column IS NULL AND tier = '{t}'), '') AS missing_{t}" for t in TIERS)}
        FROM uses u LEFT JOIN match m USING (dataset, use_case) GROUP BY ALL""",
    "quality_penalty": f"""{profile_ctes(LIBRARY)}, penalty0 AS ({PENALTY})
        SELECT *, least(null_penalty + outlier_penalty + duplicate_penalty, 20.0) AS quality_penalty FROM penalty0""",
    "readiness_recommendations": f"{readiness_ctes(LIBRARY)}, {RECOMMENDATIONS} SELECT * FROM recs",
    "readiness_risks": f"{readiness_ctes(LIBRARY)}, {RISKS} SELECT * FROM risks",
    "label_encode": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus, "
        "dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders",
    "label_encode_many": "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name, "
        "dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer",
    "median_impute": f"""SELECT event_id, coalesce(user_id::DOUBLE, (SELECT quantile_cont(user_id::DOUBLE, 0.5) FROM {source('events_holes')})) AS user_id,
        coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {source('events_holes')})) AS value FROM {source('events_holes')}""",
    "encode_features": f"""SELECT event_id::DOUBLE AS event_id, round(epoch_us(ts) / 1e6, 3) AS ts,
        coalesce(user_id::DOUBLE, (SELECT quantile_cont(user_id::DOUBLE, 0.5) FROM {source('events_holes')})) AS user_id,
        (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS event_type,
        coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {source('events_holes')})) AS value, round(value_cubed, 3) AS value_cubed
        FROM {source('events_holes')}""",
    "target_correlation": f"WITH {RETURNS_NUMBERS}, c AS (" + union(
        [f"SELECT {quote(c)} AS feature, coalesce({correlation(c, 'target', 'returns')}, 0.0) AS r" for c in RETURNS_FEATURES]
        ) + ") SELECT feature, round(r, 6) AS pearson_r, round(abs(r), 6) AS abs_r FROM c",
    "high_correlation_pairs": f"WITH {RETURNS_NUMBERS}, {PAIRS} SELECT feature_a, feature_b, round(r, 6) AS correlation FROM pairs WHERE abs(r) >= 0.85",
    "mutual_information_binned": f"WITH {RETURNS_NUMBERS} SELECT feature, round(mi_score, 6) AS mi_score FROM ({MI_BINNED})",
    "mutual_information_regression": f"WITH {PRICES_CTE}, scored AS (" + union(
        [binned_mi(c, c, "prices_y", "y_bin") for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "half_price")]
        ) + ") SELECT feature, round(mi_score, 5) AS mi_score, row_number() OVER (ORDER BY mi_score DESC, feature)::INTEGER AS rank FROM scored",
    "mutual_information_knn": f"WITH {knn_cte('l_extendedprice')}, {knn_cte('net_price')} {knn_mi('l_extendedprice')} UNION ALL {knn_mi('net_price')}",
    "mutual_information_regression_knn": plane_mi("part", "p_partkey", {
        "p_size": "p_size", "p_brand": "dense_rank() OVER (ORDER BY p_brand) - 1", "p_type": "dense_rank() OVER (ORDER BY p_type) - 1"},
        "p_retailprice"),
    "forest_best": f"""WITH {PRICES_CTE}, tasks AS (SELECT 'classification' AS task, * REPLACE ((target > 250000)::INTEGER::DOUBLE AS target) FROM prices
        UNION ALL SELECT 'regression', * FROM prices),
        told AS (SELECT task, unnest({array(PRICE_FEATURES)}) AS feature, unnest([{', '.join(f'abs(corr({c}, target))' for c in PRICE_FEATURES)}]) AS r FROM tasks GROUP BY task)
        SELECT task, count(*) AS n_ranked, 1.0::DOUBLE AS total, arg_max(feature, r) AS best FROM told GROUP BY task""",
    "transform_advice_numeric": f"WITH {advice_ctes(ADVISED)} {unnested('advice1')}",
    "transform_advice_categorical": f"WITH {advice_ctes(ADVISED)} {unnested('advice2')}",
    "model_characteristics": f"{model_ctes()} SELECT * FROM traits",
    "model_scores": f"{model_ctes()} SELECT dataset, use_case, task, model_key, score, rank FROM ranked",
    "model_top3": f"""{model_ctes()} SELECT dataset, use_case, rank, model_key, model_name, poc_days, production_days, rationale
        FROM ranked WHERE task = 'classification' AND rank <= 3""",
    "strategy": f"{model_ctes()} SELECT * FROM strategy",
    "report_summary": f"{report_ctes()} SELECT dataset, use_case, executive_summary, assessment FROM told",
    "report_findings": f"""{report_ctes()}, lists AS (SELECT dataset, use_case, unnest(['findings', 'opportunities', 'next_steps']) AS kind,
        unnest([findings, opportunities, next_steps]) AS texts FROM told)
        SELECT dataset, use_case, kind, unnest(range(1, len(texts) + 1))::INTEGER AS seq, unnest(texts) AS text FROM lists""",
    "report_markdown": f"{report_ctes()} SELECT dataset, use_case, {MARKDOWN} AS markdown FROM told",
    "report_minimal": f"{report_ctes()} SELECT dataset, use_case, {MINIMAL} AS markdown FROM told",
    "report_files": f"{report_ctes()} SELECT dataset, use_case, '# Discovery report: ' || {TITLE} AS title, score FROM told",
    "prompt_render": f"{report_ctes()} SELECT dataset, use_case, {PROMPT} AS prompt FROM told",
    "run_metadata": f"""WITH facts AS ({column_facts(LIBRARY)}) SELECT dataset, 'fraud_detection' AS use_case, 'classification' AS task,
        '{GENERATED_AT}' AS generated_at, '1.0.0' AS version, max(n_total) AS n_rows FROM facts GROUP BY 1""",
    "response_extract": RESPONSE,
    "scan_detect": union([f"SELECT '{t}' AS dataset, '.parquet' AS format, count(*) AS n_rows FROM {t}" for t in ("orders", "lineitem", "events", "documents")]),
    "scan_roundtrip_csv": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "scan_csv_missing": """SELECT CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_returnflag END AS l_returnflag, count(*) AS n,
        count(*) FILTER (l_returnflag <> 'A') AS n_quantity, round(sum(l_quantity) FILTER (l_returnflag <> 'A'), 2) AS sum_quantity,
        count(*) FILTER (l_tax <> 0) AS n_tax, max(l_orderkey) AS max_orderkey FROM lineitem GROUP BY 1""",
    "scan_roundtrip_json": "SELECT p_brand, p_name, p_partkey, p_retailprice, p_size::BIGINT AS p_size, p_type FROM part",
    "scan_csv_quoted": "SELECT doc_id, '\"' || text || '\"' || chr(10) || ',' || source AS text, n_chars FROM documents",
    "scan_json_mixed": "SELECT p_brand, p_name, p_partkey, p_retailprice, p_size::BIGINT AS p_size, p_type FROM part",
    "scan_json_columns": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "scan_json_array": "SELECT s_acctbal, s_name, s_nationkey::BIGINT AS s_nationkey, s_suppkey FROM supplier",
    "scan_roundtrip_parquet": "SELECT * FROM orders",
    "scan_roundtrip_xlsx": "SELECT * FROM customer",
    "sample_churn": CHURN,
    "sample_fraud": FRAUD,
    "sample_sales": SALES,
    "discover_sources": f"""WITH facts0 AS ({column_facts(SOURCES)}), facts AS (SELECT * REPLACE ('combined' AS dataset) FROM facts0),
        typed AS ({TYPED_COLUMNS}), profiled AS ({PROFILED}), dup AS ({duplicates(SOURCES)}),
        totals AS (SELECT 'combined' AS dataset, (SELECT sum(n) FROM (SELECT max(n_total) AS n FROM facts0 GROUP BY dataset)) AS n_rows,
          round(100.0 * sum(n_null) / sum(n_total), 2) AS overall_null_pct, (SELECT sum(n_duplicate_rows) FROM dup) AS n_duplicate_rows FROM facts0),
        {match_ctes(['combined'], ['fraud_detection'])}, penalty0 AS ({PENALTY}), {SCORES}
        SELECT dataset, use_case, raw_score, quality_penalty, score, band FROM banded""",
    "feature_tables": f"""WITH {RETURNS_NUMBERS}, {PAIRS}, {advice_ctes(['returns'])},
        n AS (SELECT least(count(*), 20) AS kept, count(*) AS n_all FROM typed WHERE "column" <> 'target')
        SELECT 'feature_correlation' AS "table", n_all AS n_rows FROM n UNION ALL SELECT 'feature_mi', kept FROM n
        UNION ALL SELECT 'feature_importance', kept FROM n UNION ALL SELECT 'feature_summary', 1
        UNION ALL SELECT 'feature_warnings', count(*) FROM typed WHERE nn = 0
        UNION ALL SELECT 'feature_pairs', count(*) FROM pairs WHERE abs(r) >= 0.85
        UNION ALL SELECT 'transform_advice', (SELECT count(*) FROM advice1 WHERE len(suggestions) > 0) + (SELECT count(*) FROM advice2)""",
    "discover_stages": """SELECT 'primary' AS dataset, seq::INTEGER AS seq, stage, 'success' AS status, 7 AS n_features, 0::BIGINT AS n_pairs
        FROM (VALUES (1, 'profile'), (2, 'readiness'), (3, 'features'), (4, 'models'), (5, 'report')) v(seq, stage)""",
}
