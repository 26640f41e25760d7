"""Sample tables with the shape of churn, fraud and sales data.

All draws are hashes of a row id, so a row is the same however the table is
split, and any table with an id column can be given such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.operators.ranks import ROWS_PER_TASK, running_totals, select_ranks

# Sizes, value lists and distribution parameters of the samples.
SAMPLE_ROWS = {"churn_prediction": 1000, "fraud_detection": 1000, "sales_forecasting": 500}
NULL_SHARE = 0.02
MERCHANTS = [
    "grocery", "gas_station", "restaurant", "online_retail",
    "travel", "entertainment", "healthcare", "atm",
]
CATEGORIES = ["Electronics", "Clothing", "Home & Garden", "Sports", "Books", "Food & Beverage"]
REGIONS = ["North", "South", "East", "West", "Central"]
PRODUCTS_PER_CATEGORY = 5
FIRST_SALE = "2023-01-01"
DAYS = 365


def load_sample(spark: SparkSession, use_case: str, n: int | None = None, seed: int = 42) -> DataFrame:
    makers = {
        "churn_prediction": churn,
        "fraud_detection": fraud,
        "sales_forecasting": sales,
    }
    if use_case not in makers:
        raise ValueError(f"Unknown sample use case '{use_case}'. Available: {sorted(makers)}")
    ids = spark.range(1, (n or SAMPLE_ROWS[use_case]) + 1).select("id")
    return makers[use_case](ids, seed)


def uniforms(ids: DataFrame, salt: str, seed: int, names: list[str]) -> DataFrame:
    """Add columns of uniform draws in [0, 1): four to a digest of the row id."""
    drawn = {}
    for i, name in enumerate(names):
        digest = F.md5(F.concat(F.lit(f"{seed}:{salt}:{i // 4}:"), F.col("id").cast("string")))
        digits = F.substring(digest, 1 + 8 * (i % 4), 8)
        drawn[name] = F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)
    return ids.withColumns(drawn)


def whole(u: str, low: int, high: int) -> Column:
    """Uniform whole number from low up to and without high."""
    return (F.lit(low) + F.floor(F.col(u) * (high - low))).cast("int")


def between(u: str, low: float, high: float) -> Column:
    return F.lit(float(low)) + F.col(u) * F.lit(float(high - low))


def exponential(u: str, scale: float) -> Column:
    return -F.ln(F.lit(1.0) - F.col(u)) * F.lit(float(scale))


def one_of(u: str, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), whole(u, 1, len(values) + 1))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def when_points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def churn(ids: DataFrame, seed: int = 42, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Customers; exactly the 2 % with the smallest draws lack total_charges."""
    drawn = uniforms(ids, "churn", seed, ["u_age", "u_tenure", "u_monthly", "u_total",
                                          "u_products", "u_calls", "u_churn", "u_null"])
    numbers = drawn.select(F.lit(0).alias("id"), F.col("u_null").alias("value"))
    n = ids.count()
    n_null = int(n * NULL_SHARE)
    limit, last_id = -1.0, None
    if n_null:
        wanted = {(0, 0.0): (float(n_null - 1), 0, 0.0, 1.0, n)}
        limit = select_ranks(numbers, wanted, rows_per_task)[0, 0.0]
        # of the rows that share the last draw, only those with the smallest ids
        below = drawn.where(F.col("u_null") < limit).count()
        tied = drawn.where(F.col("u_null") == limit).select("id")
        last_id = tied.orderBy("id").limit(n_null - below).agg(F.max("id").alias("id")).first().id
    has_total = (F.col("u_null") > limit) | ((F.col("u_null") == limit) & (F.col("id") > F.lit(last_id)))
    charge = F.round(between("u_monthly", 20, 120), 2)
    shaped = drawn.select(
        has_total.alias("has_total"),
        F.format_string("CUST-%05d", "id").alias("customer_id"),
        whole("u_age", 18, 75).alias("age"),
        whole("u_tenure", 1, 72).alias("tenure_months"),
        charge.alias("monthly_charge"),
        whole("u_products", 1, 6).alias("num_products"),
        whole("u_calls", 0, 15).alias("support_calls"),
        "u_total",
        "u_churn",
    )
    total = F.round(F.col("monthly_charge") * F.col("tenure_months") * between("u_total", 0.9, 1.1), 2)
    probability = clip(
        F.lit(0.05)
        + when_points(F.col("tenure_months") < 12, 0.3)
        + when_points(F.col("support_calls") > 5, 0.2)
        - when_points(F.col("num_products") > 3, 0.1)
        + when_points(F.col("monthly_charge") > 80, 0.1),
        0.02,
        0.85,
    )
    return shaped.select(
        "customer_id", "age", "tenure_months", "monthly_charge",
        F.when(F.col("has_total"), total).alias("total_charges"),
        "num_products", "support_calls",
        (F.col("u_churn") < probability).cast("int").alias("churn"),
    )


def fraud(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Card payments, a few of them fraudulent."""
    drawn = uniforms(ids, "fraud", seed, ["u_amount", "u_merchant", "u_time", "u_distance", "u_fraud"])
    shaped = drawn.select(
        F.format_string("TXN-%07d", "id").alias("transaction_id"),
        clip(F.round(exponential("u_amount", 80), 2), 0.5, 5000.0).alias("amount"),
        one_of("u_merchant", MERCHANTS).alias("merchant_category"),
        F.round(between("u_time", 0, 24), 2).alias("time_of_day"),
        F.round(exponential("u_distance", 15), 2).alias("distance_from_home"),
        "u_fraud",
    )
    probability = clip(
        F.lit(0.02)
        + when_points(F.col("amount") > 500, 0.15)
        + when_points((F.col("time_of_day") < 5) | (F.col("time_of_day") > 22), 0.10)
        + when_points(F.col("distance_from_home") > 50, 0.15),
        0.01,
        0.60,
    )
    flagged = (F.col("u_fraud") < probability).cast("int").alias("is_fraud")
    return shaped.select("*", flagged).drop("u_fraud")


def sales(ids: DataFrame, seed: int = 42, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Sales of a year, dates ascending with the row id.

    Only the dates are sorted. As there are few different days, it is enough to
    count them and to know each row's place in id order.
    """
    drawn = uniforms(ids, "sales", seed, ["u_day", "u_category", "u_product", "u_price", "u_units", "u_region"])
    day = whole("u_day", 0, DAYS).alias("day")
    per_day = drawn.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # at most 365 rows
    starts = per_day.select("day", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("start"))
    first_rows = sorted((r.start, r.day) for r in starts.collect())
    n = ids.count()
    placed = running_totals(drawn.withColumn("one", F.lit(1)).withColumn("all", F.lit(0)),
                            ["all"], ["id"], "one", n > rows_per_task)
    begun = F.filter(F.array(*[F.lit(s) for s, _ in first_rows]), lambda s: s <= F.col("before"))
    day_here = F.element_at(F.array(*[F.lit(d) for _, d in first_rows]), F.size(begun))
    date = F.date_add(F.lit(FIRST_SALE).cast("date"), day_here)

    codes = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c[:3].upper(), c)])
    product = F.format_string(
        "%s-%03d", F.upper(F.substring(one_of("u_category", CATEGORIES), 1, 3)),
        whole("u_product", 1, PRODUCTS_PER_CATEGORY + 1),
    )
    shaped = placed.select(
        date.alias("on"),
        product.alias("product_id"),
        F.round(between("u_price", 5, 500), 2).alias("unit_price"),
        whole("u_units", 1, 200).alias("units"),
        one_of("u_region", REGIONS).alias("region"),
    )
    code = F.split_part("product_id", F.lit("-"), F.lit(1))
    boost = F.when(F.month("on").isin(11, 12), 1.4).otherwise(1.0)
    units = (F.col("units") * boost).cast("int")
    return shaped.select(
        F.date_format("on", "yyyy-MM-dd").alias("date"),
        "product_id",
        F.coalesce(codes[code], code).alias("category"),
        units.alias("units_sold"),
        "unit_price",
        "region",
        F.round(F.col("unit_price") * units, 2).alias("revenue"),
    )
