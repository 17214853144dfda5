"""Data-quality audit, key integrity and order status profile.

Every check is a distributed count.  The audit counts what a row fails by itself where it is read, and shuffles two
columns of the orders and sums of lines and payments for the rest; the key checks meet keys as sets of bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ts_lit
from ..functions.ratios import round_ratio
from ..plans.base import dim_date, flag
from ..plans.skew import join_per_key
from ..sources.star import SCHEMAS, Star

# Audit check names, in check order.
CHECK_NAMES = {
    1: "row counts within expected range",
    2: "no duplicate order ids",
    3: "no orphan order_items (FK integrity)",
    4: "basket reconciliation: SUM(line_amount) = orders.item_total",
    5: "net_amount arithmetic holds on every order",
    6: "cancelled orders have NULL delivery time; delivered never do",
    7: "all order timestamps inside the audit window",
    8: "no order placed before its customer signed up",
    9: "ratings only on delivered orders and within 1..5",
    10: "every payment_success event maps to a real order",
    11: "non-negative money everywhere",
}


#: Ids and words that need a closer look are remembered as bits of this many, however many they are: a bounded broadcast.
_SLOT_BITS = 1 << 20


def _count_if(cond) -> F.Column:
    """0 on no rows, so a check over an empty table passes."""
    return F.count_if(cond)


def _order_faults(star: Star) -> DataFrame:
    """Checks that an order row fails by itself, counted where the rows are read."""
    lo, hi = star.params.audit_window
    status, act, rating = F.col("status"), F.col("actual_delivery_min"), F.col("rating")
    faults = {
        "c5": F.col("net_amount") != F.col("item_total") - F.col("discount_amount")
        + F.col("delivery_fee") + F.col("handling_fee"),
        "c6": ((status == "cancelled") & act.isNotNull()) | ((status == "delivered") & act.isNull()),
        "c7": (F.col("order_ts") < ts_lit(lo)) | (F.col("order_ts") >= ts_lit(hi)),
        "c9": (rating.isNotNull() & (status == "cancelled")) | (rating < 1) | (rating > 5),
        "c11": (F.col("item_total") < 0) | (F.col("discount_amount") < 0) | (F.col("net_amount") < 0)}
    return star.orders.agg(F.count(F.lit(1)).alias("n_orders"), *[_count_if(c).alias(k) for k, c in faults.items()])


def _matched(star: Star) -> DataFrame:
    """c2 and c4, and how many lines and payments have an order, as one row.

    Lines and payments are summed per order id before they are shuffled, so an order with very many lines is one row.
    Orders meet them by two columns, and as left joins keep the partitioning, the copies of an id are counted in place.
    """
    basket = star.items.groupBy("order_id").agg(F.sum("line_amount").alias("line"), F.count(F.lit(1)).alias("lines"))
    paid = star.events.where((F.col("event_name") == "payment_success") & F.col("order_id").isNotNull()).groupBy(
        "order_id").agg(F.count(F.lit(1)).alias("paid"))
    rows = star.orders.select("order_id", "item_total").join(basket, "order_id", "left").join(paid, "order_id", "left")
    per_order = rows.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("copies"), _count_if(F.col("item_total") != F.col("line")).alias("unequal"),
        F.max("lines").alias("lines"), F.max("paid").alias("paid"))
    zero = F.lit(0).cast("long")
    return per_order.agg(_count_if(F.col("copies") > 1).alias("c2"), F.coalesce(F.sum("unequal"), zero).alias("c4"),
                         F.coalesce(F.sum("lines"), zero).alias("matched_lines"),
                         F.coalesce(F.sum("paid"), zero).alias("matched_paid"))


def _marked(ids: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` as bits of a set of fixed size, to broadcast: ``near`` finds all of them and few others."""
    slot = F.pmod(F.xxhash64(key), F.lit(_SLOT_BITS))
    return ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("slots")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("marked"))


def _near(rows: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be in the set; with an empty one they are not even read."""
    slot = F.pmod(F.xxhash64(key), F.lit(_SLOT_BITS))
    found = rows.withColumn("slot", slot).withColumn("slots", F.shiftright("slot", 6)).join(F.broadcast(marked), "slots")
    return found.where(F.getbit("marked", (F.col("slot") % 64).cast("int")) == 1).select(rows.columns)


def dq_audit(star: Star) -> DataFrame:
    p = star.params
    early = join_per_key(star.orders.select("customer_id", "order_ts"), star.customer.select("customer_id", "signup_ts"),
                         "customer_id", p.hot_key_rows)
    parts = [_matched(star), _order_faults(star), early.agg(_count_if(F.col("order_ts") < F.col("signup_ts")).alias("c8")),
             star.customer.agg(F.count(F.lit(1)).alias("n_customers")),
             star.items.agg(F.count(F.lit(1)).alias("n_lines")),
             star.events.agg(F.count(F.lit(1)).alias("n_events"),
                             _count_if(F.col("event_name") == "payment_success").alias("n_paid"))]  # one row each
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    whole = whole.agg(*[F.max(c).alias(c) for c in whole.columns]).withColumns(
        {"c3": F.col("n_lines") - F.col("matched_lines"), "c10": F.col("n_paid") - F.col("matched_paid")})
    (olo, ohi), (clo, chi) = p.audit_orders_range, p.audit_customers_range
    c1 = (flag(~F.col("n_orders").between(olo, ohi)) + flag(~F.col("n_customers").between(clo, chi))
          + flag(F.col("n_events") <= p.audit_min_events)).cast("long")
    checks = whole.withColumn("c1", c1).select(F.expr(
        f"stack({len(CHECK_NAMES)}, {', '.join(f'{k}, c{k}' for k in CHECK_NAMES)}) AS (check_no, violations)"))
    names = F.create_map(*[x for k, v in CHECK_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return checks.select(F.col("check_no").cast("int").alias("check_no"),
                         names[F.col("check_no")].alias("check_name"),
                         F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("result"),
                         F.col("violations").cast("long").alias("violations"))


PRIMARY_KEYS = {
    "store": ["store_id"], "product": ["product_id"], "customer": ["customer_id"],
    "orders": ["order_id"], "items": ["order_id", "product_id"], "spend": ["month_start", "channel"],
}
FOREIGN_KEYS = [
    ("fk_customer_store", "customer", "home_store_id", "store", "store_id"),
    ("fk_orders_customer", "orders", "customer_id", "customer", "customer_id"),
    ("fk_orders_store", "orders", "store_id", "store", "store_id"),
    ("fk_items_order", "items", "order_id", "orders", "order_id"),
    ("fk_items_product", "items", "product_id", "product", "product_id"),
    ("fk_events_customer", "events", "customer_id", "customer", "customer_id"),
]


def _single_keys(star: Star) -> tuple[dict[str, DataFrame], dict[str, list[Column]]]:
    """The tables, and the entries (constraint, key, rows, parent) that a row of each gives."""
    tabs = star.tables() | {"dim_date": dim_date(star)}

    def entry(constraint: str, key: str, rows, parent: int) -> Column:
        value = F.unix_date(key) if key == "date_key" else F.col(key)
        return F.struct(F.lit(constraint).alias("constraint"), value.cast("long").alias("key"),
                        rows.cast("long").alias("rows"), F.lit(parent).alias("parent"))

    entries: dict[str, list[Column]] = {}
    for t in tabs:
        mine = [entry(f"pk_{o}", k[0], F.lit(1), 0) for o, k in (PRIMARY_KEYS | {"dim_date": ["date_key"]}).items()
                if o == t and len(k) == 1]
        mine += [entry(name, ck, flag(F.col(ck).isNotNull()), 0) for name, child, ck, _, _ in FOREIGN_KEYS if child == t]
        mine += [entry(name, pk, F.lit(0), 1) for name, _, _, parent, pk in FOREIGN_KEYS if parent == t]
        entries[t] = mine
    return tabs, entries


def dq_key_integrity(star: Star) -> DataFrame:
    """(constraint, violations): primary keys, NOT NULL columns and foreign keys.

    Single keys are integers (a date by its day number).  They travel as sets: 64 neighbouring keys of a constraint are
    the bits of one bigint, united by one map-side combined OR with the number of their rows, so unique keys that lie
    together are one row in 64.  A word whose keys are as many as its rows holds no repeated key, one whose keys the
    parent has holds no orphan; only rows of other words are counted key by key.  Those words are named to the second
    pass as bits of a set of fixed size; where all is well it is empty, and the tables are not read again.  Keys of two
    columns are counted as such.
    """
    tabs, entries = _single_keys(star)
    word = F.call_function("shiftright", F.col("key"), F.lit(6))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(F.lit(63)).cast("int"))
    rows = reduce(DataFrame.unionByName, [df.select(F.explode(F.array(*entries[t])).alias("e")).select("e.*")
                                          for t, df in tabs.items() if entries[t]])
    rows = rows.where((F.col("rows") > 0) | (F.col("parent") == 1)).withColumn("word", word)
    sets = rows.groupBy("constraint", "word").agg(
        F.sum("rows").alias("rows"), F.bit_or(F.when(F.col("parent") == 0, bit)).alias("seen"),
        F.bit_or(F.when(F.col("parent") == 1, bit)).alias("known"))
    zero = F.lit(0).cast("long")
    seen, known = F.coalesce("seen", zero), F.coalesce("known", zero)
    suspect = F.when(F.col("constraint").startswith("pk_"), F.col("rows") > F.bit_count(seen)).otherwise(
        seen.bitwiseAND(F.bitwise_not(known)) != 0)

    name = F.xxhash64("constraint", "word").alias("name")
    near = _near(rows.select("constraint", "key", "rows", "parent", name), _marked(sets.where(suspect).select(name), "name"),
                 "name")
    per_key = near.groupBy("constraint", "key").agg(F.sum("rows").alias("rows"), F.max("parent").alias("parent"))
    broken = F.when(F.col("constraint").startswith("pk_"), flag(F.col("rows") > 1)).otherwise(
        F.when(F.col("parent") == 0, F.col("rows")).otherwise(0))
    counted = [per_key.groupBy("constraint").agg(F.sum(broken).alias("violations"))]

    for t, schema in SCHEMAS.items():
        missing = reduce(lambda x, y: x | y, [F.col(f.name).isNull() for f in schema.fields if not f.nullable])
        counted.append(tabs[t].agg(_count_if(missing).alias("violations")).select(F.lit(f"not_null_{t}").alias("constraint"),
                                                                                  "violations"))
    for t, key in PRIMARY_KEYS.items():
        if len(key) > 1:
            copies = tabs[t].groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
            counted.append(copies.agg(_count_if(F.col("copies") > 1).alias("violations")).select(
                F.lit(f"pk_{t}").alias("constraint"), "violations"))
    names = [*[f"pk_{t}" for t in [*PRIMARY_KEYS, "dim_date"]], *[f"not_null_{t}" for t in SCHEMAS],
             *[fk[0] for fk in FOREIGN_KEYS]]
    listed = star.spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("constraint"))
    return listed.join(reduce(DataFrame.unionByName, counted), "constraint", "left").select(
        "constraint", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def order_status_profile(star: Star) -> DataFrame:
    return (star.orders.groupBy("status")
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("item_total").alias("gmv_rs"))
            .select("status", "orders", round_ratio("gmv_rs", "orders", 0).alias("avg_basket_rs"), "gmv_rs"))
