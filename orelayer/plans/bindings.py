"""A film-rental source derived from the order tables, so that every model runs on given data.

Parts are films, orders are rentals, order lines are payments and stock, suppliers are staff, nations are
stores, addresses and languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelayer.functions.columns import clock, money
from orelayer.sources.readers import table

EPOCH = "1995-01-01 00:00:00"


class Source:
    """The rental source tables of one folder, typed, each a lazy frame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._given: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}
        self._shipped: DataFrame | None = None
        self._inventory: DataFrame | None = None

    def given(self, name: str) -> DataFrame:
        """A table of the folder; its files are listed and its schema read once per source."""
        if name not in self._given:
            self._given[name] = table(self.spark, self.folder, name)
        return self._given[name]

    def rows(self, name: str) -> int:
        """The size of a table, counted from its file footers."""
        if name not in self._rows:
            self._rows[name] = self.given(name).count()
        return self._rows[name]

    def language(self) -> DataFrame:
        return self.given("nation").select(
            F.col("n_nationkey").alias("language_id"),
            F.col("n_name").alias("name"),
            clock(EPOCH).alias("last_update"),
        )

    def address(self) -> DataFrame:
        nation, region = self.given("nation"), self.given("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
            F.col("n_nationkey").alias("address_id"),
            F.col("n_name").alias("address"),
            F.lit(None).cast("string").alias("address2"),
            F.col("r_name").alias("district"),
            F.col("n_regionkey").alias("city_id"),
            F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("postal_code"),
            F.lit(None).cast("string").alias("phone"),
            clock(EPOCH).alias("last_update"),
        )

    def store(self) -> DataFrame:
        managers = self.given("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("manager_staff_id"))
        nation = self.given("nation")
        return nation.join(managers, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
            F.col("n_nationkey").alias("store_id"),
            "manager_staff_id",
            F.col("n_nationkey").alias("address_id"),
            clock(EPOCH).alias("last_update"),
        )

    def film(self) -> DataFrame:
        size = F.col("p_size")
        return self.given("part").select(
            F.col("p_partkey").alias("film_id"),
            F.col("p_name").alias("title"),
            F.concat("p_name", F.lit(" "), "p_type").alias("description"),
            (size + 1990).alias("release_year"),
            size.alias("language_id"),
            F.lit(None).cast("int").alias("original_language_id"),
            size.alias("rental_duration"),
            (size.cast("decimal(4,2)") + F.lit(0.99).cast("decimal(2,2)")).cast("decimal(4,2)").alias("rental_rate"),
            (size + 60).alias("length"),
            money("p_retailprice").alias("replacement_cost"),
            F.col("p_brand").alias("rating"),
            clock(EPOCH).alias("last_update"),
        )

    def customer(self) -> DataFrame:
        name = F.split("c_name", "#")
        return self.given("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_nationkey").alias("store_id"),
            name[0].alias("first_name"),
            name[1].alias("last_name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.col("c_nationkey").alias("address_id"),
            (F.col("c_acctbal") >= 0).alias("active"),
            clock(EPOCH).alias("create_date"),
            clock(EPOCH).alias("last_update"),
        )

    def staff(self) -> DataFrame:
        name = F.split("s_name", "#")
        return self.given("supplier").select(
            F.col("s_suppkey").alias("staff_id"),
            name[0].alias("first_name"),
            name[1].alias("last_name"),
            F.col("s_nationkey").alias("address_id"),
            F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
            F.col("s_nationkey").alias("store_id"),
            (F.col("s_acctbal") >= 0).alias("active"),
            F.col("s_name").alias("username"),
            clock(EPOCH).alias("last_update"),
        )

    def inventory(self) -> DataFrame:
        """One copy per part that was ever shipped, kept in the store of its first supplier; at most one per part.

        The same frame is given every time: a plan that uses it twice has its shuffle once, and one that uses it once writes nothing.
        """
        if self._inventory is not None:
            return self._inventory
        stocked = self.given("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("_supplier"))
        supplier = self.given("supplier")
        copies = stocked.join(supplier, F.col("_supplier") == F.col("s_suppkey"), "left").select(
            F.col("l_partkey").alias("inventory_id"),
            F.col("l_partkey").alias("film_id"),
            F.col("s_nationkey").alias("store_id"),
            clock(EPOCH).alias("last_update"),
        )
        self._inventory = copies
        return self._inventory

    def shipped(self) -> DataFrame:
        """Per order the last shipment, the copy, the staff and the sum paid: one pass over the lines, however often a plan uses it."""
        if self._shipped is None:
            self._shipped = self.given("lineitem").groupBy("l_orderkey").agg(
                F.max("l_shipdate").alias("return_date"),
                F.min("l_partkey").alias("inventory_id"),
                F.min("l_suppkey").alias("staff_id"),
                F.sum(_paid()).cast("decimal(12,2)").alias("amount"),
            )
        return self._shipped

    def rental(self) -> DataFrame:
        """Orders, out from the order date to the last shipment; open if nothing was shipped."""
        orders, shipped = self.given("orders"), self.shipped()
        return orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("rental_id"),
            F.col("o_orderdate").alias("rental_date"),
            "return_date",
            "inventory_id",
            F.col("o_custkey").alias("customer_id"),
            "staff_id",
            F.coalesce("return_date", "o_orderdate").alias("last_update"),
        )

    def paid(self) -> DataFrame:
        """Payments as :meth:`payment` has them, summed per rental."""
        return self.shipped().select(F.col("l_orderkey").alias("rental_id"), "amount")

    def payment(self) -> DataFrame:
        return self.given("lineitem").select(F.col("l_orderkey").alias("rental_id"), _paid().alias("amount"))

    def tables(self) -> dict[str, DataFrame]:
        names = ["language", "address", "store", "film", "customer", "staff", "inventory", "rental", "payment"]
        return {name: getattr(self, name)() for name in names}


def _paid() -> Column:
    paid = money("l_extendedprice", "decimal(12,2)") * (F.lit(1) - money("l_discount", "decimal(4,2)"))
    return paid.cast("decimal(12,2)")


def accounts_before(source: Source) -> DataFrame:
    """A snapshot of customer accounts."""
    return source.given("customer").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("holder"),
        F.col("c_nationkey").alias("nation_id"),
        money("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.lower("c_name").alias("holder_cache"),
    )


def accounts_after(source: Source, since: str = "2001-01-01 00:00:00") -> DataFrame:
    """The next snapshot: recent orders are charged, idle overdrawn accounts are closed, one segment is
    retired to null, suppliers open accounts under negative ids, and a derived column changes everywhere."""
    charged = (
        source.given("orders")
        .where(F.col("o_orderdate") >= clock(since))
        .groupBy("o_custkey")
        .agg(F.sum(money("o_totalprice")).alias("_charged"))
    )
    before = accounts_before(source)
    kept = (
        before.join(charged, F.col("account_id") == F.col("o_custkey"), "left")
        .where((F.col("balance") >= 0) | F.col("_charged").isNotNull())
        .select(
            "account_id",
            "holder",
            "nation_id",
            (F.col("balance") - F.coalesce("_charged", F.lit(0))).cast("decimal(18,2)").alias("balance"),
            F.nullif("segment", F.lit("MACHINERY")).alias("segment"),
            F.upper("holder").alias("holder_cache"),
        )
    )
    opened = source.given("supplier").select(
        (-F.col("s_suppkey") - 1).alias("account_id"),
        F.col("s_name").alias("holder"),
        F.col("s_nationkey").alias("nation_id"),
        money("s_acctbal").alias("balance"),
        F.lit("SUPPLIER").alias("segment"),
        F.upper("s_name").alias("holder_cache"),
    )
    return kept.unionByName(opened)
