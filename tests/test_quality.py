"""Audit: a clean hand-made star passes; each dirty table fails exactly its check."""

import datetime as dt

import pytest

from growthlens.config import FIXTURES
from growthlens.operators.quality import dq_audit, dq_key_integrity
from tests.helpers import D, T, customer, order, star_from_rows, stores

P = FIXTURES.with_(audit_window=(D(2000, 1, 1), D(2001, 1, 1)))


def clean_rows():
    return dict(
        store=stores(),
        product=[(1, "p1", "cat", 100, 60, 0)],
        customer=[customer(1, T(2000, 1, 1)), customer(2, T(2000, 2, 1))],
        orders=[order(10, 1, T(2000, 3, 1, 10), item_total=200, rating=5),
                order(11, 2, T(2000, 3, 2, 10), status="cancelled", item_total=100)],
        items=[(10, 1, 2, 100, 200), (11, 1, 1, 100, 100)],
        events=[(1, 1, "payment_success", T(2000, 3, 1, 10), "android", 10),
                (1, 1, "app_open", T(2000, 3, 1, 9), "android", None)],
        spend=[(D(2000, 1, 1), "organic", 0)],
    )


def results(spark, rows):
    star = star_from_rows(spark, P, **rows)
    return {r.check_no: (r.result, r.violations) for r in dq_audit(star).collect()}


def test_clean_star_passes_every_check(spark):
    res = results(spark, clean_rows())
    assert sorted(res) == list(range(1, 12))
    assert all(v == ("PASS", 0) for v in res.values()), res


def _dirty(check):
    r = clean_rows()
    if check == 1:
        r["orders"] = []
        r["items"] = []
        r["events"] = []
    elif check == 2:
        r["orders"].append(r["orders"][0])
    elif check == 3:
        r["items"].append((99, 1, 1, 5, 5))
    elif check == 4:
        r["items"][0] = (10, 1, 2, 100, 150)
    elif check == 5:
        o = list(r["orders"][0]); o[11] += 1; r["orders"][0] = tuple(o)
    elif check == 6:
        o = list(r["orders"][1]); o[6] = 10; r["orders"][1] = tuple(o)
    elif check == 7:
        r["orders"].append(order(12, 1, T(2002, 1, 1), item_total=0))
    elif check == 8:
        r["orders"].append(order(12, 2, T(2000, 1, 15), item_total=0))
    elif check == 9:
        o = list(r["orders"][1]); o[13] = 3; r["orders"][1] = tuple(o)
    elif check == 10:
        r["events"].append((2, 2, "payment_success", T(2000, 3, 2), "ios", 777))
    elif check == 11:
        o = list(r["orders"][0]); o[8] = -5; o[11] = o[7] - o[8] + o[9] + o[10]; r["orders"][0] = tuple(o)
    return r


@pytest.mark.parametrize("check", range(1, 12))
def test_each_dirty_table_fails_only_its_check(spark, check):
    p = P.with_(audit_orders_range=(1, 10), audit_customers_range=(1, 10), audit_min_events=0)
    star = star_from_rows(spark, p, **_dirty(check))
    res = {r.check_no: r.result for r in dq_audit(star).collect()}
    failed = sorted(k for k, v in res.items() if v == "FAIL")
    assert failed == [check], (check, res)  # also on empty tables, where the other checks have nothing to fault


def test_key_integrity_counts_orphans_and_duplicates(spark):
    r = clean_rows()
    r["items"].append((99, 1, 1, 5, 5))            # orphan item -> fk_items_order
    r["customer"].append(customer(2, T(2000, 2, 1)))  # duplicate customer id
    got = {x.constraint: x.violations for x in dq_key_integrity(star_from_rows(spark, P, **r)).collect()}
    assert got["fk_items_order"] == 1
    assert got["pk_customer"] == 1
    assert got["fk_orders_customer"] == 0
    assert sum(v for k, v in got.items() if k not in ("fk_items_order", "pk_customer")) == 0


def test_payment_without_order_id_counts_as_a_violation(spark):
    p = P.with_(audit_orders_range=(1, 10), audit_customers_range=(1, 10), audit_min_events=0)
    r = _dirty(10)
    r["events"].append((3, 2, "payment_success", T(2000, 3, 3), "ios", None))
    res = {x.check_no: x.violations for x in dq_audit(star_from_rows(spark, p, **r)).collect()}
    assert res[10] == 2  # the unknown id 777 and the NULL id


def test_orphans_count_rows_not_keys(spark):
    r = clean_rows()
    r["items"] += [(99, 1, 1, 5, 5), (99, 2, 1, 5, 5), (98, 1, 2, 5, 10)]  # three rows, two orphan keys
    got = {x.constraint: x.violations for x in dq_key_integrity(star_from_rows(spark, P, **r)).collect()}
    assert got["fk_items_order"] == 3


def test_key_sets_count_as_key_by_key(spark):
    """Random dirty tables, with NULL, negative and far ids: the violations are those of plain counts."""
    import random
    from collections import Counter

    for seed in range(4):
        rnd = random.Random(seed)
        ids = [rnd.randrange(-200, 200) for _ in range(60)] + [2 ** 62, -2 ** 62, 64, 63, -64, -1, 0]
        cust = rnd.sample(ids, 30) + (ids[:3] * 2 if seed else [])
        oids = list(dict.fromkeys(ids)) + (ids[:5] if seed else [])
        orders = [order(o, rnd.choice(ids), T(2000, 5, 2), store=rnd.randrange(9)) for o in oids]
        items = [(rnd.choice(ids), rnd.randrange(5), 1, 10, 10) for _ in range(80)]
        events = [(i, rnd.choice(ids + [777]), "app_open", T(2000, 5, 2), "ios", None) for i in range(50)]
        star = star_from_rows(spark, P, store=stores(), product=[(i, "p", "c", 10, 5, 0) for i in range(4)],
                              customer=[customer(c, T(2000, 1, 1), home=rnd.randrange(10)) for c in cust],
                              orders=orders, items=items, events=events)
        got = {x.constraint: x.violations for x in dq_key_integrity(star).collect()}

        def repeated(keys):
            return sum(n > 1 for n in Counter(keys).values())

        customers = [(r.customer_id, r.home_store_id) for r in star.customer.collect()]
        want = {"pk_customer": repeated(cust), "pk_orders": repeated(oids), "pk_items": repeated((i[0], i[1]) for i in items),
                "pk_store": 0, "pk_product": 0, "pk_spend": 0, "pk_dim_date": 0,
                "fk_customer_store": sum(h >= 8 for _, h in customers),
                "fk_orders_customer": sum(o[1] not in cust for o in orders),
                "fk_orders_store": sum(o[2] >= 8 for o in orders), "fk_items_order": sum(i[0] not in oids for i in items),
                "fk_items_product": sum(i[1] >= 4 for i in items), "fk_events_customer": sum(e[1] not in cust for e in events)}
        assert {k: v for k, v in got.items() if not k.startswith("not_null")} == want


def test_clean_keys_are_met_as_words(spark):
    """Unique keys that lie together: one row in 64 is shuffled, and nothing is counted key by key."""
    star = star_from_rows(spark, P, store=stores(), customer=[customer(c, T(2000, 1, 1)) for c in range(6_400)],
                          orders=[order(o, o % 6_400, T(2000, 5, 2)) for o in range(6_400)])
    df = dq_key_integrity(star)
    assert all(r.violations == 0 for r in df.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and "concat_ws" not in plan


def test_baskets_of_repeated_order_ids(spark):
    """An id with several totals: each of its rows is held against the lines."""
    def o(i, total, n=1):
        return [order(i, 1, T(2000, 5, 2), item_total=total)] * n

    def item(i, amount):
        return (i, 1, 1, amount, amount)

    star = star_from_rows(spark, P, store=stores(), product=[(1, "p", "c", 10, 5, 0)], customer=[customer(1, T(2000, 1, 1))],
                          orders=o(1, 100) + o(2, 100) + o(2, 90, 2) + o(2, 80) + o(3, 50, 3) + o(4, 50, 2) + o(5, 9) + o(5, 8),
                          items=[item(1, 100), item(2, 90), item(3, 50), item(4, 51)])
    res = {x.check_no: x.violations for x in dq_audit(star).collect()}
    assert res[4] == 2 + 2 and res[2] == 4  # id 2: the rows of 100 and 80; id 4: both; id 5 has no lines


def test_the_audit_is_a_plain_hash_aggregate(spark):
    star = star_from_rows(spark, P, orders=[order(1, 1, T(2000, 5, 2))])
    assert "ObjectHashAggregate" not in dq_audit(star)._jdf.queryExecution().executedPlan().toString()
