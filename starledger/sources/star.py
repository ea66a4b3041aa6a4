"""The sales star schema as a bundle of DataFrames.

``SalesModel`` holds the three dimensions and five facts every report reads.
It can be

* loaded from stored Parquet tables (``load_star``), the production path;
* derived from the TPC-H-like driver tables (``derive_star``), following the
  documented fixture derivation; or
* derived once and written to the shared checkpoint folder
  (``materialize_star``), facts partitioned by ``fiscal_year`` so fiscal-year
  filters prune whole directories.

Everything is lazy: building a model runs no Spark job.
"""

from __future__ import annotations

import dataclasses
import math
import threading
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.functions.dates import fiscal_year
from starledger.session import drop_path, path_exists, shared_dir, shuffles_freed, size_shuffles
from starledger.sources.act_est import integrate_act_est  # noqa: F401 - part of the model's interface
from starledger.streaming.upsert import ActEstTable

STAR_TABLES = (
    "dim_customer",
    "dim_product",
    "dim_date",
    "fact_sales_monthly",
    "fact_gross_price",
    "fact_pre_invoice_deductions",
    "fact_post_invoice_deductions",
    "fact_forecast_monthly",
)

#: Key of the three-key join of sales and post-invoice deductions.
PAIR_KEYS = ("customer_code", "product_code", "date")
#: Bytes of one bucket of a table bucketed by that key (at about ROW_BYTES a row), and most buckets.
BUCKET_BYTES, ROW_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 256 << 20, 24, 8, 16_384
#: Rows of one bucket as long as there are at most so many buckets: a task sorts whole buckets of both tables, on
#: a small heap in so many spilled runs that the readers of these, 2 MB each, don't fit into it.
BUCKET_ROWS, SMALL_BUCKETS = 1 << 20, 128
#: Column of the sales layout that holds the market of a row's customer.
MARKET_COLUMN = "_market"

#: Estimated bytes of a table's rows in memory from which it isn't broadcast, whatever the size of its files.
BROADCAST_BYTES = 10 << 20
#: Sides of the joins with sales that grow with the data.
JOINED_TABLES = ("dim_customer", "dim_product", "fact_gross_price", "fact_pre_invoice_deductions", "fact_post_invoice_deductions")

# Facts partitioned on disk by fiscal year (the reports' most common filter).
FY_PARTITIONED = ("fact_sales_monthly", "fact_gross_price", "fact_pre_invoice_deductions", "fact_forecast_monthly")


@dataclass(frozen=True)
class SalesModel:
    dim_customer: DataFrame
    dim_product: DataFrame
    dim_date: DataFrame
    fact_sales_monthly: DataFrame
    fact_gross_price: DataFrame
    fact_pre_invoice_deductions: DataFrame
    fact_post_invoice_deductions: DataFrame
    fact_forecast_monthly: DataFrame
    # Materialised actual-vs-forecast table (None: derived on demand from the facts).
    fact_act_est: DataFrame | None = None
    # Further layouts of the same rows, made with the star (None: not stored).
    market_months: DataFrame | None = None  # plans/summary.py
    sales_by_market: DataFrame | None = None  # sales with their customer's market, clustered by it
    sales_by_key: DataFrame | None = None  # sales and post-invoice deductions, bucketed and sorted by their
    post_by_key: DataFrame | None = None  # common key

    def replace(self, **tables: DataFrame) -> "SalesModel":
        """The model with other tables; layouts that were derived from the old ones are dropped."""
        derived = dict.fromkeys(("market_months", "sales_by_market", "sales_by_key", "post_by_key"))
        if not set(tables) & set(STAR_TABLES):
            derived = {}
        return dataclasses.replace(self, **(derived | tables))

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in STAR_TABLES}

    def register_views(self, prefix: str = "") -> None:
        """Expose every table as a temp view for SQL users."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)


# --------------------------------------------------------------------------- stored star


def _read_table(spark: SparkSession, path: str, name: str, schemas: dict | None = None) -> DataFrame:
    reader = spark.read
    if schemas and name in schemas:
        reader = reader.schema(schemas[name])  # known schema: no inference job
    df = reader.parquet(f"{path}/{name}")
    # Partition columns are typed explicitly (independent of partition type inference).
    if name in FY_PARTITIONED:
        df = df.withColumn("fiscal_year", F.col("fiscal_year").cast("int"))
    return df


def buckets_for(rows: int) -> int:
    """Buckets of a table of so many rows: a power of two, so that tables of different size stay joinable."""
    wanted = max(rows * ROW_BYTES / BUCKET_BYTES, min(SMALL_BUCKETS, rows / BUCKET_ROWS))
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(wanted, 1))))))


def _is_large(df: DataFrame, rows: int) -> bool:
    """Whether ``rows`` rows like those of ``df`` take more than BROADCAST_BYTES in memory."""
    return rows * (16 + sum(32 if kind == "string" else 8 for _, kind in df.dtypes)) > BROADCAST_BYTES


def _joined_by_sort(df: DataFrame, rows: int) -> DataFrame:
    """``df``, merged with what it is joined to if its rows are large. Spark estimates a scan by its compressed
    files, a small part of the rows that the driver would hold to broadcast them."""
    return df.hint("merge") if _is_large(df, rows) else df


def _by_rows(model: SalesModel, rows: dict[str, int]) -> SalesModel:
    """``model`` with joins chosen by the tables' rows. Sales meet the price list last in size, so they are
    merged wherever it is."""
    size_shuffles(model.fact_sales_monthly.sparkSession, max(rows.values(), default=0))
    tables = {t: _joined_by_sort(getattr(model, t), rows[t]) for t in JOINED_TABLES if t in rows}
    layouts = {}
    if model.post_by_key is not None and "fact_post_invoice_deductions" in rows:
        layouts["post_by_key"] = _joined_by_sort(model.post_by_key, rows["fact_post_invoice_deductions"])
    if _is_large(model.fact_gross_price, rows.get("fact_gross_price", 0)):
        tables["fact_sales_monthly"] = model.fact_sales_monthly.hint("merge")
        layouts |= {t: getattr(model, t).hint("merge") for t in ("sales_by_market", "sales_by_key") if getattr(model, t) is not None}
    return dataclasses.replace(model, **tables, **layouts)


def _catalogue_name(path: str, name: str) -> str:
    return f"starledger_{zlib.crc32(path.encode()):08x}_{name}"


def _write_bucketed(df: DataFrame, path: str, name: str, buckets: int) -> None:
    """``df`` as a catalogue table over ``path``, bucketed and sorted by PAIR_KEYS in each fiscal year: one
    file for each bucket and year."""
    dealt = df.repartition(buckets, *PAIR_KEYS)
    writer = dealt.write.mode("overwrite").format("parquet").partitionBy("fiscal_year").bucketBy(buckets, *PAIR_KEYS).sortBy(*PAIR_KEYS)
    writer.option("path", f"{path}/{name}").saveAsTable(_catalogue_name(path, name))


def _read_bucketed(spark: SparkSession, path: str, name: str, buckets: int) -> DataFrame:
    """The catalogue table over ``path``; another session than the one that wrote it declares it first."""
    table = _catalogue_name(path, name)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema.fields)
        keys = ", ".join(PAIR_KEYS)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (fiscal_year) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        spark.catalog.recoverPartitions(table)
    return spark.table(table)


def load_star(spark: SparkSession, path: str, with_act_est: bool = True, schemas: dict | None = None) -> SalesModel:
    """Read a stored star (one Parquet folder per table, as written by ``write_star``);
    ``schemas`` (as returned by ``write_star``) skips schema inference."""
    path = path.rstrip("/")
    if not path_exists(spark, f"{path}/_layout"):  # plain tables, written by others
        plain = SalesModel(**{t: _read_table(spark, path, t, schemas) for t in STAR_TABLES})
        return _with_act_est(spark, path, _by_rows(plain, {t: getattr(plain, t).count() for t in JOINED_TABLES}), with_act_est)
    model = _stored_facts(spark, path, schemas)
    return _with_act_est(spark, path, model.replace(market_months=spark.read.parquet(f"{path}/market_months")), with_act_est)


def _stored_facts(spark: SparkSession, path: str, schemas: dict | None = None) -> SalesModel:
    """The tables and layouts of a star that ``write_star`` stored, without its summaries."""
    layout = spark.read.schema("buckets int, rows map<string, bigint>").parquet(f"{path}/_layout").first()
    by_market = _read_table(spark, path, "fact_sales_monthly")
    pair = {t: _read_bucketed(spark, path, t, layout["buckets"]) for t in ("sales_by_key", "fact_post_invoice_deductions")}
    tables = {t: _read_table(spark, path, t, schemas) for t in STAR_TABLES if t not in ("fact_sales_monthly", "fact_post_invoice_deductions")}
    tables["fact_sales_monthly"] = by_market.select("date", "fiscal_year", "product_code", "customer_code", "sold_quantity")
    tables["fact_post_invoice_deductions"] = pair["fact_post_invoice_deductions"].select("customer_code", "product_code", "date", "discounts_pct", "other_deductions_pct")
    model = SalesModel(
        **tables,
        sales_by_market=by_market,
        sales_by_key=pair["sales_by_key"].select("date", F.col("fiscal_year").cast("int").alias("fiscal_year"), "product_code", "customer_code", "sold_quantity"),
        post_by_key=pair["fact_post_invoice_deductions"].withColumn("fiscal_year", F.col("fiscal_year").cast("int")),
    )
    return _by_rows(model, layout["rows"] or {})


def _with_act_est(spark: SparkSession, path: str, model: SalesModel, wanted: bool) -> SalesModel:
    table = ActEstTable(spark, f"{path}/fact_act_est")
    if wanted and table.exists():  # else the reports derive it from the facts
        return model.replace(fact_act_est=table.read())
    return model


def act_est_facts(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> list[DataFrame]:
    """The stored facts that ``fact_act_est`` is rebuilt from."""
    return [_read_table(spark, path, t) for t in ("fact_sales_monthly", "fact_forecast_monthly")]


def write_star(model: SalesModel, path: str, parallel: int = 1) -> dict:
    """Write every table under ``path``; fiscal-year facts are partitioned by ``fiscal_year``
    and clustered by customer inside each partition (row-group pruning on customer filters), sales by
    their customer's market first. Sales are also stored bucketed with the post-invoice deductions, so
    that their join needs no exchange, and summed to market months. A write's shuffle files go with it, so the
    disk holds those of one table at a time. Returns the written schemas."""
    with shuffles_freed(model.fact_sales_monthly.sparkSession):
        return _write_star(model, path, parallel)


def _write_star(model: SalesModel, path: str, parallel: int) -> dict:
    from starledger.plans.summary import build_market_months

    path = path.rstrip("/")
    tables = model.tables()
    buckets = buckets_for(model.fact_sales_monthly.count())
    spark = model.fact_sales_monthly.sparkSession
    markets = model.dim_customer.select("customer_code", F.col("market").alias(MARKET_COLUMN)).dropDuplicates(["customer_code"])
    markets = _joined_by_sort(markets, model.dim_customer.count())
    sales = tables["fact_sales_monthly"].select("date", "fiscal_year", "product_code", "customer_code", "sold_quantity")
    tables["fact_sales_monthly"] = sales.join(markets, "customer_code", "left").select(*sales.columns, MARKET_COLUMN)
    tables["sales_by_key"] = sales
    tables["fact_post_invoice_deductions"] = model.fact_post_invoice_deductions.withColumn("fiscal_year", fiscal_year("date"))

    def write_one(name: str, df: DataFrame) -> None:
        if name in FY_PARTITIONED:
            # Range-partition on (fiscal_year, clustering keys): a fiscal year is spread over many
            # tasks, each file covers a narrow customer range, so customer filters skip row groups.
            # The further keys split a customer that holds much of a year.
            keys = [c for c in (MARKET_COLUMN, "customer_code", "product_code", "date") if c in df.columns]
            clustered = df.repartitionByRange("fiscal_year", *keys).sortWithinPartitions("fiscal_year", *keys)
            clustered.write.mode("overwrite").partitionBy("fiscal_year").parquet(f"{path}/{name}")
        elif name in ("fact_post_invoice_deductions", "sales_by_key"):
            _write_bucketed(df, path, name, buckets)
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    # The tables are independent; ``parallel > 1`` submits their jobs concurrently
    # (useful when many small tables would leave a large cluster idle).
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        for future in [pool.submit(write_one, name, df) for name, df in tables.items()]:
            future.result()
    rows = F.create_map(*(F.lit(x) for t in JOINED_TABLES for x in (t, spark.read.parquet(f"{path}/{t}").count())))
    spark.range(1).select(F.lit(buckets).alias("buckets"), rows.cast("map<string, bigint>").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/_layout")
    build_market_months(_stored_facts(spark, path)).write.mode("overwrite").parquet(f"{path}/market_months")
    ActEstTable(spark, f"{path}/fact_act_est").rebuild(*act_est_facts(spark, path, tables))
    return {name: df.schema for name, df in model.tables().items()}


def materialize_star(spark: SparkSession, model: SalesModel, path: str | None = None) -> SalesModel:
    """Write ``model`` to the shared checkpoint folder (or ``path``) and read it back.

    This cuts the lineage of the derived star: later reports scan compact
    partitioned Parquet instead of re-running the lineitem x orders join.
    """
    target = path or shared_dir(spark, "star")
    schemas = write_star(model, target)
    return load_star(spark, target, schemas=schemas)


def build_star(spark: SparkSession, base: str, path: str | None = None) -> SalesModel:
    """ETL: derive the star from the driver tables, store it, return the stored model.

    The monthly sales grain (the one lineitem x orders join) is written first and
    every fact is derived from the stored grain, so the big join runs once even
    though each partitioned write samples and scans its input. The grain goes when they are stored.
    """
    target = (path or shared_dir(spark, "star")).rstrip("/")
    grain = f"{target}/_sales_grain"
    with shuffles_freed(spark):
        size_shuffles(spark, _read(spark, base, "lineitem", []).count())
        derive_sales_grain(spark, base).write.mode("overwrite").parquet(grain)
        model = derive_star(spark, base, grain=spark.read.parquet(grain))
        schemas = write_star(model, target)
    drop_path(spark, grain)
    return load_star(spark, target, schemas=schemas)


_STARS: dict[tuple, SalesModel] = {}
_STARS_LOCK = threading.Lock()


def _fingerprint(spark: SparkSession, base: str) -> tuple:
    """Names, sizes and times of the driver tables' files: a star of changed tables is built anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path(base))))


def star_for(spark: SparkSession, base: str) -> SalesModel:
    """The stored star for the driver tables under ``base``, built once per Spark
    application (``build_star`` into the shared checkpoint folder) and reused."""
    key = (spark.sparkContext.applicationId, base.rstrip("/"), _fingerprint(spark, base))
    with _STARS_LOCK:
        if key not in _STARS:
            _STARS[key] = build_star(spark, base)
        return _STARS[key]


# --------------------------------------------------------------------------- derivation


def _read(spark: SparkSession, base: str, table: str, cols: list[str]) -> DataFrame:
    # Explicit column lists: only these columns reach the Parquet ReadSchema.
    return spark.read.parquet(f"{base.rstrip('/')}/{table}.parquet").select(*cols)


def derive_dim_customer(spark: SparkSession, base: str) -> DataFrame:
    customer = _read(spark, base, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nation = _read(spark, base, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = _read(spark, base, "region", ["r_regionkey", "r_name"])
    # nation (25 rows) and region (5 rows) have a fixed size: safe to broadcast.
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    c = customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey)
    key = F.col("c_custkey")
    return c.select(
        key.alias("customer_code"),
        F.concat(F.lit("Account "), (key % 200).cast("string")).alias("customer"),
        F.when(key % 3 == 0, F.lit("E-Commerce")).otherwise(F.lit("Brick & Mortar")).alias("platform"),
        F.col("c_mktsegment").alias("channel"),
        F.col("n_name").alias("market"),
        F.concat(F.col("r_name"), F.lit("-"), (key % 4).cast("string")).alias("sub_zone"),
        F.col("r_name").alias("region"),
    )


def derive_dim_product(spark: SparkSession, base: str) -> DataFrame:
    part = _read(spark, base, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    return part.select(
        F.col("p_partkey").alias("product_code"),
        F.col("p_type").alias("division"),
        F.col("p_brand").alias("segment"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("category"),
        F.col("p_name").alias("product"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("variant"),
    )


def derive_sales_grain(spark: SparkSession, base: str) -> DataFrame:
    """lineitem x orders aggregated to the monthly (date, product, customer) grain.

    One join and one aggregation produce the sales quantity *and* both
    deduction facts (same grain), so the expensive join runs once.
    """
    li = _read(spark, base, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax"])
    od = _read(spark, base, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    # Two facts: neither is broadcast, however small its files.
    joined = li.join(od.hint("merge"), li.l_orderkey == od.o_orderkey)
    return joined.groupBy(
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"),
        F.col("l_partkey").alias("product_code"),
        F.col("o_custkey").alias("customer_code"),
    ).agg(
        F.sum("l_quantity").cast("int").alias("sold_quantity"),
        F.max("l_discount").cast("decimal(5,4)").alias("discounts_pct"),
        F.max("l_tax").cast("decimal(5,4)").alias("other_deductions_pct"),
    )


def forecast_from_sales(fact_sales: DataFrame) -> DataFrame:
    """Synthetic forecast: drop ~10% of keys, move ~10% one month later, scale the rest.

    The move applies to every row of a (product, customer) pair alike, so the
    (date, product, customer) key stays unique and no re-aggregation is needed.
    """
    k = (F.col("product_code") + F.col("customer_code")) % 10
    date = F.when(k == 1, F.add_months(F.col("date"), 1)).otherwise(F.col("date")).cast("date")
    factor = F.lit(60) + (F.col("product_code") * 7 + F.col("customer_code") * 3) % 81
    return (
        fact_sales.filter(k != 0)
        .select(
            date.alias("date"),
            "product_code",
            "customer_code",
            F.floor(F.col("sold_quantity") * factor / F.lit(100)).cast("int").alias("forecast_quantity"),
        )
        .withColumn("fiscal_year", fiscal_year("date"))
        .select("date", "fiscal_year", "product_code", "customer_code", "forecast_quantity")
    )


def gross_price_for_years(spark: SparkSession, base: str, fact_sales: DataFrame) -> DataFrame:
    """Price list: every part for every fiscal year that has sales (2% yearly uplift).

    The set of fiscal years is a one-row scalar subquery (a handful of values),
    exploded per part: no join, no driver round-trip.
    """
    part = _read(spark, base, "part", ["p_partkey", "p_retailprice"])
    years = fact_sales.agg(F.sort_array(F.collect_set("fiscal_year"))).scalar()
    priced = part.select(F.col("p_partkey").alias("product_code"), "p_retailprice", F.explode(years).alias("fiscal_year"))
    uplift = (F.lit(1) + F.expr("0.02") * (F.col("fiscal_year") - F.lit(1995))).cast("decimal(4,2)")
    return priced.select(
        "product_code",
        "fiscal_year",
        (F.col("p_retailprice").cast("decimal(7,2)") * uplift).cast("decimal(9,4)").alias("gross_price"),
    )


def derive_star(spark: SparkSession, base: str, grain: DataFrame | None = None) -> SalesModel:
    """Build the star from the TPC-H-like tables under ``base`` (lazy).

    ``grain`` may be a stored copy of ``derive_sales_grain`` (see ``build_star``).
    """
    grain = grain if grain is not None else derive_sales_grain(spark, base)
    fact_sales = grain.select(
        "date", fiscal_year("date").alias("fiscal_year"), "product_code", "customer_code", "sold_quantity"
    )
    post = grain.select("customer_code", "product_code", "date", "discounts_pct", "other_deductions_pct")
    pre = grain.groupBy("customer_code", fiscal_year("date").alias("fiscal_year")).agg(
        F.max("discounts_pct").alias("pre_invoice_discount_pct")
    )
    dim_date = fact_sales.select(F.col("date").alias("calendar_date"), "fiscal_year").distinct()
    return SalesModel(
        dim_customer=derive_dim_customer(spark, base),
        dim_product=derive_dim_product(spark, base),
        dim_date=dim_date,
        fact_sales_monthly=fact_sales,
        fact_gross_price=gross_price_for_years(spark, base, fact_sales),
        fact_pre_invoice_deductions=pre,
        fact_post_invoice_deductions=post,
        fact_forecast_monthly=forecast_from_sales(fact_sales),
    )
