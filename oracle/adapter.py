"""DuckDB twin of the fixture adapter and of the base views.

Written independently of the Spark code: plain window functions (row_number,
lag + running sum) where the Spark side uses skew-safe aggregate plans, so the
differential check compares two different formulations of the same rules.
Only parameters are shared (from ``growthlens.config``).
"""

from __future__ import annotations

import datetime as _dt

from growthlens.config import FIXTURES, Params


def d(x: _dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def ts(x: _dt.date) -> str:
    return f"TIMESTAMP '{x.isoformat()} 00:00:00'"


def pct(num: str, den: str, scale: int = 1, mult: int = 100) -> str:
    """round_half_away(mult*num/den, scale) as DOUBLE; NULL when den = 0."""
    k = 2 * 10**scale * mult
    return (f"(CASE WHEN ({den}) = 0 THEN NULL ELSE "
            f"sign({num}) * ((abs(CAST({num} AS HUGEINT)) * {k} + CAST({den} AS HUGEINT)) "
            f"// (2 * CAST({den} AS HUGEINT))) END)::DOUBLE / {10**scale}::DOUBLE")


def rnd(num: str, den: str, scale: int = 0) -> str:
    return pct(num, den, scale, 1)


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def month(x: str) -> str:
    return f"CAST(date_trunc('month', {x}) AS DATE)"


def mdiff(a: str, b: str) -> str:
    """Month boundaries from a to b."""
    return f"((year({b}) * 12 + month({b})) - (year({a}) * 12 + month({a})))"


def ddiff(a: str, b: str) -> str:
    """Midnights from a to b."""
    return f"date_diff('day', CAST({a} AS DATE), CAST({b} AS DATE))"


def esec(x: str) -> str:
    return f"(epoch_us({x}) // 1000000)"


def prefix(p: Params = FIXTURES) -> str:
    stressed = ", ".join(str(s) for s in p.stressed_stores)
    return f"""
st_store AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS store_id, 'ST-' || CAST(n.n_nationkey AS VARCHAR) AS store_code,
         n.n_name AS zone_name, r.r_name AS city, DATE '1994-01-01' AS launch_date,
         CAST(10 + n.n_nationkey % 5 AS BIGINT) AS base_promise_min
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
st_product AS (
  SELECT CAST(p_partkey AS BIGINT) AS product_id, p_name AS product_name, p_type AS category,
         (CAST(round(p_retailprice * 100) AS BIGINT) + 50) // 100 AS unit_price,
         (CAST(round(p_retailprice * 100) AS BIGINT) * (60 + p_size % 30)) // 10000 AS unit_cost,
         CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END AS is_private_label
  FROM part),
li AS (
  SELECT CAST(l_orderkey AS BIGINT) AS order_id, CAST(l_partkey AS BIGINT) AS product_id,
         CAST(l_quantity AS BIGINT) AS qty,
         (CAST(round(l_extendedprice * 100) AS BIGINT) + 50) // 100 AS amt,
         (CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) + 5000) // 10000 AS disc
  FROM lineitem),
li_grp AS (
  SELECT order_id, product_id, CAST(SUM(qty) AS BIGINT) AS quantity, CAST(SUM(amt) AS BIGINT) AS line_amount,
         CAST(SUM(disc) AS BIGINT) AS disc_amount
  FROM li GROUP BY order_id, product_id),
st_items AS (
  SELECT order_id, product_id, quantity, line_amount // quantity AS unit_price, line_amount FROM li_grp),
li_tot AS (
  SELECT order_id, CAST(SUM(line_amount) AS BIGINT) AS lines_total, CAST(SUM(disc_amount) AS BIGINT) AS disc_total
  FROM li_grp GROUP BY order_id),
o0 AS (
  SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_custkey AS BIGINT) AS customer_id,
         o_orderstatus, o_orderpriority,
         CAST(o_orderdate AS TIMESTAMP) + to_seconds((o_orderkey * 7919) % 86400) AS order_ts
  FROM orders),
o1 AS (
  SELECT o0.*,
         CASE WHEN (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') OR customer_id % 20 = 19
              THEN 'cancelled' ELSE 'delivered' END AS status,
         CAST(CASE WHEN order_id % 25 = 0 THEN (c.c_nationkey + 1) % 25 ELSE c.c_nationkey END AS BIGINT) AS store_id
  FROM o0 LEFT JOIN customer c ON c.c_custkey = o0.customer_id),
o2 AS (
  SELECT o1.*,
         CAST(10 + store_id % 5 + CASE WHEN hour(order_ts) IN (8, 9, 10, 18, 19, 20, 21) THEN 2 ELSE 0 END AS BIGINT)
           AS promised_min
  FROM o1),
o3 AS (
  SELECT o2.*,
         CAST(CASE WHEN status = 'cancelled' THEN NULL
              ELSE promised_min + (order_id * 31) % 17 - 10
                   + CASE WHEN store_id IN (4, 6) AND order_ts >= TIMESTAMP '2000-01-01 00:00:00' THEN 6 ELSE 0 END
              END AS BIGINT) AS actual_delivery_min,
         CASE WHEN status = 'delivered' AND (order_id * 13) % 29 = 0 THEN 1 ELSE 0 END AS items_missing,
         COALESCE(t.lines_total, 0) AS item_total,
         CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN COALESCE(t.disc_total, 0) ELSE 0 END AS BIGINT)
           AS discount_amount
  FROM o2 LEFT JOIN li_tot t USING (order_id)),
o4 AS (
  SELECT o3.*, CAST(CASE WHEN item_total < 100000 THEN 25 ELSE 0 END AS BIGINT) AS delivery_fee,
         CAST(4 AS BIGINT) AS handling_fee
  FROM o3),
st_orders AS (
  SELECT order_id, customer_id, store_id, order_ts, status, promised_min, actual_delivery_min,
         item_total, discount_amount, delivery_fee, handling_fee,
         item_total - discount_amount + delivery_fee + handling_fee AS net_amount,
         CASE order_id % 4 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' WHEN 2 THEN 'cod' ELSE 'wallet' END AS payment_method,
         CAST(CASE WHEN status = 'cancelled' OR order_id % 2 = 0 THEN NULL
              ELSE greatest(1, 5 - CASE WHEN actual_delivery_min > promised_min THEN 1 ELSE 0 END
                                 - 2 * CASE WHEN actual_delivery_min > promised_min + 5 THEN 1 ELSE 0 END
                                 - items_missing
                                 - CASE WHEN order_id % 7 = 0 THEN 1 ELSE 0 END) END AS BIGINT) AS rating,
         items_missing
  FROM o4),
first_any AS (
  SELECT customer_id, MIN(order_ts) AS first_any_ts FROM o0 GROUP BY customer_id),
st_customer AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS customer_id,
         COALESCE(f.first_any_ts, TIMESTAMP '1995-01-01 00:00:00')
           - to_seconds((c.c_custkey * 37 % 40) * 86400 + (c.c_custkey * 131 % 24) * 3600) AS signup_ts,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'paid_search' WHEN 'BUILDING' THEN 'organic'
              WHEN 'FURNITURE' THEN 'paid_social' WHEN 'HOUSEHOLD' THEN 'referral'
              WHEN 'MACHINERY' THEN 'influencer' END AS acquisition_channel,
         CASE WHEN c.c_custkey % 3 = 0 THEN 'ios' ELSE 'android' END AS platform,
         CAST(c.c_nationkey AS BIGINT) AS home_store_id
  FROM customer c LEFT JOIN first_any f ON f.customer_id = c.c_custkey),
ev0 AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS customer_id, event_type,
         epoch_us(ts) // 1000000 - 8219 * 86400 AS t
  FROM events),
ev1 AS (
  SELECT *, lag(t) OVER (PARTITION BY customer_id ORDER BY t, event_id) AS prev_t FROM ev0),
ev2 AS (
  SELECT *, CASE WHEN prev_t IS NULL OR t - prev_t > {p.session_gap_seconds} THEN 1 ELSE 0 END AS is_start FROM ev1),
ev3 AS (
  SELECT *, SUM(is_start) OVER (PARTITION BY customer_id ORDER BY t, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_idx
  FROM ev2),
ev4 AS (
  SELECT CAST(customer_id * 100000 + session_idx AS BIGINT) AS session_id, customer_id, event_type, event_id,
         TIMESTAMP '1970-01-01 00:00:00' + to_seconds(t) AS event_ts,
         CASE WHEN customer_id % 3 = 0 THEN 'ios' ELSE 'android' END AS platform, is_start
  FROM ev3),
st_events AS (
  SELECT session_id, customer_id,
         CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart'
              WHEN 'signup' THEN 'checkout_start' WHEN 'purchase' THEN 'payment_success'
              WHEN 'error' THEN 'search' END AS event_name,
         event_ts, platform,
         CASE WHEN event_type = 'purchase' THEN event_id END AS order_id
  FROM ev4
  UNION ALL
  SELECT session_id, customer_id, 'app_open', event_ts, platform, CAST(NULL AS BIGINT) FROM ev4 WHERE is_start = 1),
st_spend AS (
  SELECT {month('signup_ts')} AS month_start, acquisition_channel AS channel,
         CAST(COUNT(*) * CASE acquisition_channel WHEN 'organic' THEN 0 WHEN 'referral' THEN 120
              WHEN 'paid_social' THEN 300 WHEN 'paid_search' THEN 270 WHEN 'influencer' THEN 380 END AS BIGINT)
           AS spend_inr
  FROM st_customer GROUP BY 1, 2),
st_dates AS (
  SELECT CAST(unnest(range(date_trunc('month', min(t)) - INTERVAL 1 MONTH, date_trunc('month', max(t)) + INTERVAL 2 MONTH,
                           INTERVAL 1 DAY)) AS DATE) AS date_key
  FROM (SELECT order_ts AS t FROM st_orders UNION ALL SELECT signup_ts FROM st_customer
        UNION ALL SELECT event_ts FROM st_events UNION ALL SELECT CAST(month_start AS TIMESTAMP) FROM st_spend)),
dim_date AS (
  SELECT date_key, year(date_key) AS year, month(date_key) AS month, {month('date_key')} AS month_start,
         monthname(date_key) AS month_name, strftime(date_key, '%Y-%m') AS year_month, day(date_key) AS day,
         isodow(date_key) - 1 AS day_of_week, dayname(date_key) AS day_name,
         CASE WHEN isodow(date_key) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CAST(date_key - (isodow(date_key) - 1) * INTERVAL 1 DAY AS DATE) AS week_start
  FROM st_dates),
oa AS (SELECT * FROM st_orders WHERE order_ts < {ts(p.as_of_end)}),
-- line economics of an order: sales less cost of goods
econ AS (
  SELECT order_id, CAST(SUM(line_amount) - SUM(quantity * unit_cost) AS BIGINT) AS item_margin
  FROM st_items i JOIN (SELECT product_id, unit_cost FROM st_product) c USING (product_id) GROUP BY ALL),
-- a customer's delivered orders as one sorted list of (time, id, store, lateness, missing)
history AS (
  SELECT customer_id, list_sort(list({{'at': order_ts, 'id': order_id, 'store': store_id,
           'late': actual_delivery_min - promised_min, 'missing': items_missing}})) AS h
  FROM oa WHERE status = 'delivered' GROUP BY ALL),
od AS (
  SELECT o.order_id, o.customer_id, o.store_id, o.order_ts, o.order_ts::DATE AS order_date,
         {month('o.order_ts')} AS order_month, o.promised_min, o.actual_delivery_min,
         greatest(o.actual_delivery_min - o.promised_min, 0) AS late_by_min,
         (o.actual_delivery_min - o.promised_min <= 0)::INTEGER AS is_on_time,
         (o.actual_delivery_min - o.promised_min > {p.late_tolerance_min})::INTEGER AS is_late_5plus,
         o.items_missing::INTEGER AS items_missing,
         (o.actual_delivery_min - o.promised_min <= 0 AND o.items_missing = 0)::INTEGER AS is_perfect_order,
         o.item_total, o.discount_amount, o.delivery_fee, o.handling_fee, o.net_amount, o.payment_method, o.rating,
         (h.h[1].id = o.order_id)::INTEGER AS is_first_order
  FROM oa o JOIN history h USING (customer_id) WHERE o.status = 'delivered'),
cf AS (
  SELECT c.customer_id, c.signup_ts, c.signup_ts::DATE AS signup_date, {month('c.signup_ts')} AS cohort_month,
         c.acquisition_channel, c.platform, c.home_store_id, h[1].at AS first_order_ts, h[1].store AS first_store_id,
         (epoch_us(h[1].at) // 3600000000 - epoch_us(c.signup_ts) // 3600000000)::DOUBLE / 24 AS days_to_first_order,
         COALESCE(epoch_us(h[1].at) - epoch_us(c.signup_ts) <= {p.activation_days} * 86400000000, FALSE)::INTEGER AS activated_7d,
         (h IS NULL)::INTEGER AS never_ordered,
         COALESCE(h[1].late > {p.late_tolerance_min} OR h[1].missing = 1, FALSE)::INTEGER AS bad_first_experience
  FROM st_customer c LEFT JOIN history USING (customer_id) WHERE c.signup_ts < {ts(p.as_of_end)}),
om AS (
  SELECT order_id, customer_id, store_id, order_month, order_ts, item_total, item_margin, discount_amount,
         delivery_fee + handling_fee AS fees_collected,
         item_margin - discount_amount + (delivery_fee + handling_fee) - {p.last_mile_cost} AS contribution_rs
  FROM od JOIN econ USING (order_id)),
sf AS (
  SELECT session_id, customer_id, MIN(event_ts) AS session_start, {month('MIN(event_ts)')} AS session_month,
         MAX(platform) AS platform,
         bool_or(event_name = 'search')::INTEGER AS used_search,
         bool_or(event_name = 'product_view')::INTEGER AS reached_pv,
         bool_or(event_name = 'add_to_cart')::INTEGER AS reached_cart,
         bool_or(event_name = 'checkout_start')::INTEGER AS reached_checkout,
         bool_or(event_name = 'payment_success')::INTEGER AS converted,
         MAX(event_ts) FILTER (WHERE event_name = 'payment_success') AS payment_ts
  FROM st_events WHERE event_ts < {ts(p.as_of_end)} GROUP BY ALL),
-- one wide row per customer: months since signup with an order, distinct order times, spans between order days
cw AS (
  SELECT cf.*, a.months, a.offsets, a.times, a.days, a.n_orders, a.gmv, a.discounted,
         COALESCE(list_contains(a.offsets, 1), FALSE)::INTEGER AS active_m1,
         {ddiff('a.times[-1]', d(p.as_of))} AS days_since_last
  FROM cf LEFT JOIN (
    SELECT od.customer_id, list_sort(list(DISTINCT order_month)) AS months,
           list_sort(list(DISTINCT {mdiff(month('signup_ts'), 'order_month')})) AS offsets,
           list_sort(list(DISTINCT order_ts)) AS times, list_sort(list(DISTINCT order_date)) AS days,
           COUNT(*) AS n_orders, SUM(item_total) AS gmv, COUNT(*) FILTER (WHERE discount_amount > 0) AS discounted
    FROM od JOIN st_customer USING (customer_id) GROUP BY ALL) a USING (customer_id)),
ca AS (SELECT customer_id, cohort_month, acquisition_channel, unnest(offsets) AS month_offset FROM cw)
"""


def build(p: Params, ctes: str, select: str) -> str:
    """Full statement: adapter + base views + query CTEs + final SELECT."""
    more = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {prefix(p).strip()}{more}\n{select.strip()}"
