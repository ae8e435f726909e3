"""Cases by rule, on small literal frames."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import functions as F

from orrery.functions import exprs as X
from orrery.functions import versioned as S
from orrery.operators import contracts as C
from orrery.operators import ingest as I
from orrery.operators import pools as P
from orrery.operators import quality as V
from orrery.operators import reads as R


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_latest_by_version_breaks_ties_by_all_columns(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z"), (2, 1, None)], "k int, v int, x string")
    assert rows(S.latest_by_version(df, ["k"], "v"), "k", "v", "x") == [(1, 5, "b"), (2, 1, None)]


def test_keyset_pages_meet(spark):
    df = spark.range(10).select("id")
    first = S.keyset_page(df, ["id"], 4)
    assert [r.id for r in first.collect()] == [9, 8, 7, 6] and first.first().has_next and not first.first().has_prev
    last = S.keyset_page(df, ["id"], 4, (2,))
    assert [r.id for r in last.collect()] == [1, 0] and not last.first().has_next and last.first().has_prev
    back = S.keyset_page(df, ["id"], 4, (5,), backward=True)
    assert [r.id for r in back.collect()] == [9, 8, 7, 6] and back.first().has_next and not back.first().has_prev


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, 20.0), (1, 5, 50.0), (1, 6, 60.0)], "k int, at int, p double")
    assert rows(S.asof_left(left, right, ["k"], "t", "at", ["p"], step=2), "k", "t", "at", "p") == rows(S.asof_left(left, right, ["k"], "t", "at", ["p"]), "k", "t", "at", "p")
    near = S.asof_left(left, right, ["k"], "t", "at", ["p"]).collect()
    for step, reach in ((1, 2), (2, 3), (3, 100), (50, 1)):  # rows within reach are found, whatever the stretches
        got = {(r.k, r.t): (r["at"], r.p) for r in S.asof_left(left, right, ["k"], "t", "at", ["p"], step=step, reach=reach).collect()}
        assert all(got[r.k, r.t] == (r["at"], r.p) for r in near if r["at"] is None or r.t - r["at"] <= reach) and len(got) == len({(r.k, r.t) for r in near})
    assert rows(S.asof_left(left, right, ["k"], "t", "at", ["p"]), "k", "t", "at", "p") == [(1, 1, None, None), (1, 5, 5, 50.0), (2, 9, None, None)]


def test_equal_operations_fold(spark):
    ops = spark.createDataFrame([(1, 1, 1, [7, 3]), (1, 1, 2, [3, 7, 7]), (1, 1, 3, [7])], "transaction_id int, type int, application_order int, pool_ids array<int>")
    assert rows(I.operations_fold(ops, ["type"]), "amount", "application_order", "pool_ids") == [(1, 3, [7]), (2, 1, [3, 7])]


def test_pool_amounts_of_atoms_and_deltas(spark):
    key = "transaction_id int, application_order int, ledger_sequence int, pool_id int"
    atoms = spark.createDataFrame([(1, 1, 9, 1, "usd", 5596939, "native", 1396629), (1, 1, 9, 1, "usd", 10208417, "native", 2548470)], f"{key}, asset_bought string, amount_bought bigint, asset_sold string, amount_sold bigint")
    deltas = spark.createDataFrame([(2, 1, 9, 1, "native", 5000, 4000), (2, 1, 9, 1, "usd", 7000, 5000), (2, 1, 9, 1, "eur", 5, 5)], f"{key}, asset_id string, before bigint, after bigint")
    found = rows(I.lp_operation_amounts(atoms, deltas), "transaction_id", "asset_id", "amount")
    assert found == [(1, "native", -3945099), (1, "usd", 15805356), (2, "native", -1000), (2, "usd", -2000)]


def test_net_settled(spark):
    big = 10**37 * 9
    cases = (
        [(1, "x", "a", -5), (1, "x", "b", 5), (2, "x", "a", -5), (2, "x", "b", 5), (2, "x", "b", -5), (2, "x", "c", 5), (3, "x", "a", 5), (4, "x", "a", 5), (4, "x", "a", -5), (5, "x", "a", big), (5, "x", "b", big), (5, "y", "a", 1), (6, "x", "a", None)]
    )
    cases = [(*c[:3], None if c[3] is None else Decimal(c[3])) for c in cases]
    deltas = spark.createDataFrame(cases, "transaction_id int, asset_id string, holder_id string, delta decimal(38,0)")
    found = {(t, a): None if n is None else int(n) for t, a, n in rows(I.net_settled(deltas), "transaction_id", "asset_id", F.coalesce("net_settled", F.lit(-1)))}
    # transfer; chain; mint; a cycle is 0; overflow voids its own asset only; a delta that isn't known voids the sum
    assert found == {(1, "x"): 5, (2, "x"): 5, (3, "x"): 5, (4, "x"): 0, (5, "x"): -1, (5, "y"): 1, (6, "x"): -1}


def test_balance_deltas_of_created_and_removed(spark):
    changes = spark.createDataFrame([(1, "a", "x", 1, None, 10), (1, "a", "x", 2, 10, 30), (1, "b", "x", 3, 7, None), (1, "c", "x", 4, 5, 5)], "transaction_id int, holder_id string, asset_id string, change_index int, before bigint, after bigint")
    assert [(h, int(d)) for h, d in rows(I.balance_deltas(changes), "holder_id", "delta")] == [("a", 30), ("b", -7)]


def test_positions_keep_the_first_deposit(spark):
    changes = spark.createDataFrame([(1, "a", 5, 1, "created", 10), (1, "a", 8, 1, "updated", 20), (1, "a", 9, 1, "removed", 20), (1, "b", 7, 1, "updated", 3)], "pool_id int, account_id string, ledger_sequence int, order int, change_type string, shares bigint")
    assert rows(I.lp_positions(changes), "account_id", "shares", F.coalesce("first_deposit_ledger", F.lit(-1))) == [("a", 0, 5), ("b", 3, -1)]


def test_account_states_last_write_of_a_line_wins(spark):
    def change(i, kind, entry, key, data):
        return ("t", 3, i, kind, entry, json.dumps(key), None if data is None else json.dumps(data))

    changes = spark.createDataFrame(
        [
            change(0, "state", "account", {"account_id": "GA"}, {"balance": 1, "sequence": 1}),
            change(1, "created", "account", {"account_id": "GA"}, {"balance": 50, "sequence": 9, "home_domain": "a.b"}),
            change(2, "removed", "trustline", {"account_id": "GA", "asset": "X"}, None),
            change(3, "created", "trustline", {"account_id": "GA", "asset": "X"}, {"balance": 4}),
            change(4, "removed", "trustline", {"account_id": "GA", "asset": "Y"}, None),
            change(5, "updated", "trustline", {"account_id": "GB", "asset": "X"}, {"balance": 8}),
            change(6, "updated", "trustline", {"account_id": "GB", "pool_id": "p"}, {"balance": 8}),
            change(7, "removed", "account", {"account_id": "GC"}, None),
        ],
        "transaction_hash string, ledger_sequence int, change_index int, change_type string, entry_type string, key string, data string",
    )
    got = {r.account_id: r for r in I.account_states(changes).collect()}
    assert (got["GA"].native_balance, got["GA"].sequence_number, got["GA"].first_seen_ledger) == (50, 9, 3)
    assert [tuple(x) for x in got["GA"].lines] == [("X", 4)] and got["GA"].removed == ["Y"]
    assert got["GB"].sequence_number == -1 and got["GB"].native_balance is None
    assert got["GC"].native_balance == 0


def test_classification_and_routes(spark):
    code = spark.createDataFrame([("a", ["owner_of", "decimals"]), ("b", ["decimals"]), ("c", ["x"]), ("d", None)], "code_hash string, functions array<string>")
    assert rows(C.classify_contracts(code), "code_hash", "verdict") == [("a", 2), ("b", 3), ("c", 1), ("d", 1)]
    events = spark.createDataFrame([(k,) for k in "nftpuh"], "contract_id string")
    batch = spark.createDataFrame([("n", 2), ("f", 3), ("t", 0), ("p", 1)], "contract_id string, verdict int")
    history = spark.createDataFrame([("h", 2), ("f", 2)], "contract_id string, verdict int")
    assert dict(rows(C.route_by_verdict(events, batch, history), "contract_id", "route")) == {"n": "hot", "f": "dropped", "t": "dropped", "p": "pending", "u": "pending", "h": "hot"}


def test_call_trace_of_unbalanced_stack(spark):
    trace = spark.createDataFrame(
        [("t", 0, "return", None, "S"), ("t", 1, "call", "A", "S"), ("t", 2, "call", "B", "S"), ("t", 3, "return", None, "S"), ("t", 4, "call", "C", "S"), ("t", 5, "return", None, "S"), ("t", 6, "return", None, "S"), ("t", 7, "call", "D", "S")],
        "transaction_id string, event_index int, what string, contract_id string, source string",
    )
    auth = spark.createDataFrame([("t", 0, "Z", 0, "S"), ("u", 0, "Z", 0, "S")], "transaction_id string, invocation_index int, contract_id string, depth int, caller string")
    assert rows(C.call_trace(trace, auth), "transaction_id", "contract_id", "depth", "caller") == [("t", "A", 0, "S"), ("t", "B", 1, "A"), ("t", "C", 1, "A"), ("t", "D", 0, "S"), ("u", "Z", 0, "S")]


def event(topics, data, kind="contract", source="op", contract="C1"):
    return ("t", 0, contract, 5, kind, source, json.dumps(topics), json.dumps(data))


EVENT = "transaction_id string, event_index int, contract_id string, ledger_sequence int, event_type string, source string, topics string, data string"


def sym(x):
    return {"type": "sym", "value": x}


def address(x):
    return {"type": "address", "value": x}


def test_token_events(spark):
    text = {"type": "string", "value": "USD:GI"}
    df = spark.createDataFrame(
        [event([sym("Transfer"), address("GA"), address("GB"), text], {}), event([sym("mint"), address("GA"), {"type": "string", "value": "native"}], {}), event([sym("burn"), address("GA")], {}), event([sym("transfer"), address("GA")], {}), event([sym("mint"), address("GA")], {}, source="diagnostic"), event([text], {})], EVENT,
    )
    found = sorted(str(tuple(r)) for r in C.token_events(df).select("kind", "from", "to", "asset").collect())
    assert found == ["('burn', 'GA', None, 'contract:C1')", "('mint', None, 'GA', 'native')", "('transfer', 'GA', 'GB', 'USD:GI')"]


def test_nft_events_in_three_shapes(spark):
    number = {"type": "u32", "value": "7"}
    df = spark.createDataFrame(
        [
            event([sym("mint"), address("GA")], number),
            event([sym("transfer")], {"type": "vec", "value": [address("GA"), address("GB"), number]}),
            event([sym("burn"), address("GA")], {"type": "map", "value": {"token_id": number}}),
            event([sym("mint"), address("GA")], {"type": "map", "value": {"amount": number}}),
            event([sym("mint"), address("GA")], {"type": "void"}),
        ],
        EVENT,
    )
    found = sorted(str(tuple(r)) for r in C.nft_events(df).select("kind", "from", "to", "token_id").collect())
    assert found == ["('burn', 'GA', None, '7')", "('mint', None, 'GA', '7')", "('transfer', 'GA', 'GB', '7')"]


def test_consecutive_mints_drop_bad_ranges(spark):
    def span(a, b):
        return {"type": "vec", "value": [{"type": "u32", "value": str(a)}, {"type": "u64", "value": str(b)}]}

    df = spark.createDataFrame([event([sym("consecutive_mint"), address("GA")], span(a, b)) for a, b in ((3, 5), (5, 3), (0, 65_535), (9, 9))], EVENT)
    assert sorted(r.token_id for r in C.consecutive_mints(df).collect()) == ["3", "4", "5", "9"]


def test_code_upgrades_keep_identity_and_skip_unknown(spark):
    contracts = spark.createDataFrame([("C1", "old", 1, "GD")], "contract_id string, code_hash string, version int, deployer string")
    up = [sym("executable_update"), {"type": "bytes", "value": "old"}, {"type": "bytes", "value": "new"}]
    df = spark.createDataFrame([event(up, {}, kind="system"), event(up, {}, kind="system", contract="C9"), event(up, {}, kind="contract")], EVENT)
    assert rows(C.code_upgrades(contracts, df), "contract_id", "code_hash", "version", "deployer") == [("C1", "new", 5, "GD")]


def test_pool_activity_kinds(spark):
    key = "pool_id int, ledger_sequence int, transaction_id int, application_order int"
    legs = spark.createDataFrame([(1, 1, 1, 1, "A", 5), (1, 1, 1, 1, "B", 6), (1, 1, 2, 1, "A", -5), (1, 1, 2, 1, "B", -6), (1, 1, 3, 1, "A", 5), (1, 1, 3, 1, "B", 0), (1, 1, 4, 1, "A", 5)], f"{key}, leg string, amount bigint")
    legs = legs.unionByName(spark.createDataFrame([(2, 1, 3, 1, "A", 1), (2, 1, 3, 1, "B", -1)], legs.schema))
    ops = spark.createDataFrame([(1, 1, 1, None, 9)], "transaction_id int, application_order int, pool_id int, source_id int, tx_source_id int")
    got = {(r.transaction_id, r.pool_id): (r.kind, r.source_id, r.pools_crossed) for r in P.pool_activity(legs, ops).collect()}
    assert got == {(1, 1): ("deposit", 9, 1), (2, 1): ("withdrawal", None, 1), (3, 1): ("trade", None, 2), (3, 2): ("trade", None, 2), (4, 1): (None, None, 1)}


def test_pool_chart_by_close_time(spark):
    """Price of the snapshot's own bucket, carried for two days at most, weeks from Monday, a bucket void with an unpriced trade."""
    pools = spark.createDataFrame([(1, "X", "Y", 30)], "pool_id int, leg_a string, leg_b string, fee_bps int")
    at = {10: "2024-01-02 05:00:00", 11: "2024-01-02 23:00:00", 12: "2024-01-05 01:00:00", 13: "2024-01-07 12:00:00", 14: "2024-01-08 00:00:00"}
    ledgers = spark.createDataFrame([(s, t) for s, t in at.items()] * 2, "sequence int, closed_at string")
    snaps = [(1, 10, 100, 200, 5), (1, 11, 100, 300, None), (1, 12, 100, 100, 4), (1, 13, 10, 10, None), (1, 14, 7, 7, 1)]
    snapshots = spark.createDataFrame(snaps + snaps[:1], "pool_id int, ledger_sequence int, reserve_a int, reserve_b int, gross_volume_a int")
    prices = spark.createDataFrame([("X", "2024-01-01 00:00:00", 1.0), ("X", "2024-01-02 00:00:00", 2.0), ("X", "2024-01-03 00:00:00", 0.0), ("Y", "2024-01-01 00:00:00", 1.0), ("X", "2024-01-08 00:00:00", 3.0), ("Y", "2024-01-08 00:00:00", 1.0)], "leg string, bucket string, close_usd double")
    prices = prices.withColumn("bucket", F.col("bucket").cast("timestamp"))

    def chart(interval, now=None):
        return {r.bucket[:10]: (r.tvl_usd, r.volume_usd, r.fee_usd, r.samples) for r in P.pool_chart(pools, snapshots, ledgers, prices, interval, 48 * 3600, now).collect()}

    days = chart("1d")
    assert days == {"2024-01-02": (500.0, 10.0, 0.03, 2), "2024-01-05": (None, None, None, 1), "2024-01-07": (None, None, None, 1), "2024-01-08": (28.0, 3.0, 0.009, 1)}
    assert chart("1w") == {"2024-01-01": (500.0, None, None, 4), "2024-01-08": (28.0, 3.0, 0.009, 1)}
    assert chart("1d", F.lit("2024-01-08 09:00:00").cast("timestamp"))["2024-01-08"] == (None, None, None, 1)  # the open bucket has no price yet
    assert len(P.pool_chart(pools, snapshots, ledgers, prices, "1h", 48 * 3600).collect()) == 5


def test_pool_filter(spark):
    df = spark.createDataFrame([("XLM", "USDC"), ("USDC", "EURC"), ("XLMFISH", "YUSDC"), ("USDC", "USDC")], "a string, b string")

    def found(text):
        return df.where(X.pool_filter(text, F.col("a"), F.col("b"))).count()

    assert X.asset_codes(" usdc / a/b ") == ["USDC", "A/B"]
    assert [found(t) for t in (None, "usdc", "xlm/usdc", "usdc/xlm", "usdc/usdc", "/eurc")] == [4, 4, 2, 2, 1, 1]


def test_texts(spark):
    one = spark.range(1)
    usd = one.select(*[X.usd_text(F.lit(x).cast("double")).alias(f"c{i}") for i, x in enumerate((12.345678, 0.0, 0.003, 0.00009, 0.01, None))]).first()
    assert list(usd) == ["12.35", "0.00", "0.0030", "0.000090", "0.01", None]
    fees = one.select(*[X.fee_percent(F.lit(x)).alias(f"c{x}") for x in (30, 100, 5, 125)]).first()
    assert list(fees) == ["0.3", "1", "0.05", "1.25"]
    equal = one.select(*[X.decimal_text_equal(F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate((("1.0000000", "1"), ("1.0", "1.000"), ("10", "1"), ("0.10", "0.1")))]).first()
    assert list(equal) == [True, True, False, True]
    kinds = one.select(*[X.classify_query(F.lit(t)).alias(f"c{i}") for i, t in enumerate(("a" * 64, "GABC", "CZZ", "G", "usd", " gabc ", "czz", "g1", "A" * 63))]).first()
    assert list(kinds) == ["hash", "account", "contract", "text", "text", "account", "contract", "text", "text"]
    assert [X.key_prefix(t) for t in (" gabc ", "CZ", "G", "g1", "", None, "G" * 57)] == ["GABC", "CZ", None, None, None, None, None]
    import base64
    import binascii

    body = bytes([11 << 3]) + bytes(range(32))
    pool = base64.b32encode(body + binascii.crc_hqx(body, 0).to_bytes(2, "little")).decode()
    assert X.asked_hash(pool.lower()) == bytes(range(32)).hex() and X.asked_hash("AB" * 32) == "ab" * 32 and X.asked_hash(pool[:-1] + "A") is None and X.asked_hash("usd") is None


def test_search_by_shape_and_in_batches(spark):
    from orrery.operators import search as SE

    accounts = spark.createDataFrame([("GABC", "a.org"), ("GABD", None), ("GZZZ", "")], "account_key string, home_domain string")
    found = sorted(tuple(r) for r in SE.search_accounts(accounts, ["gab", "", "  ", "abc", "GZ"]).select("query", "route", "label").collect())
    assert found == [("GZ", "GZZZ", ""), ("gab", "GABC", "a.org"), ("gab", "GABD", "")]
    assert SE.search_accounts(accounts, "").count() == 0
    contracts = spark.createDataFrame([("CABC", "Gab things"), ("CABD", "cab"), ("CZZZ", None)], "contract_key string, name string")
    found = sorted(tuple(r) for r in SE.search_contracts(contracts, ["cab", "gab", "b t"]).select("query", "route").collect())
    assert found == [("b t", "CABC"), ("cab", "CABC"), ("cab", "CABD")]
    top = SE.search_all([SE.search_contracts(contracts, ["cab", "b t"]), SE.search_accounts(accounts, ["gab"])], 1)
    assert sorted((r.query, r.kind, r.route) for r in top.collect()) == [("b t", "contract", "CABC"), ("cab", "contract", "CABC"), ("gab", "account", "GABC")]


def test_asset_ids_of_pool_legs_fold_both_credit_types(spark):
    null = F.lit(None).cast("bigint")
    a, b, c = spark.range(1).select(X.pool_leg_asset_id(F.lit(1), F.lit("USD"), F.lit(5)), X.pool_leg_asset_id(F.lit(2), F.lit("USD"), F.lit(5)), X.asset_id(F.lit(1), F.lit("USD"), F.lit(5), null)).first()
    assert a == b == c is not None


def test_stories(spark):
    cases = {
        "Payment": (["PAYMENT"], 1), "Payments · 3": (["PAYMENT"], 3), "Swap · 2 ops": (["CHANGE_TRUST", "PATH_PAYMENT_STRICT_SEND"], 2), "Contract call": (["INVOKE_HOST_FUNCTION", "PAYMENT"], 2),
        "Account creation · 3 ops": (["BEGIN_SPONSORING_FUTURE_RESERVES", "CREATE_ACCOUNT", "END_SPONSORING_FUTURE_RESERVES"], 3), "Contract maintenance": (["RESTORE_FOOTPRINT"], 1), None: (["PAYMENT", "SET_OPTIONS"], 2),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "story string, labels array<string>, n int")
    assert all(a == b for a, b in df.select("story", X.classify_tx(F.col("labels"), F.col("n"))).collect())


def test_nft_transfers_look_over_the_whole_history(spark):
    own = spark.createDataFrame([(1, 1, 5, 0, 10, 0), (1, 1, 6, 0, 11, 1), (1, 1, 6, 1, None, 2)], "contract_id int, token_id int, ledger_sequence int, event_order int, owner_id int, event_type int")
    assert [tuple(r) for r in R.nft_transfers(own).orderBy("ledger_sequence", "event_order").select("from_id", "to_id").collect()] == [(None, 10), (10, 11), (11, None)]


def test_balance_aggregates(spark):
    df = spark.createDataFrame([(1, 100), (1, 50), (1, 0)], "asset_id int, amount bigint")
    assert rows(R.balance_aggregates(df), "supply", "holders") == [(150, 2)]


def test_checks_count_and_sample(spark):
    df = spark.createDataFrame([(i,) for i in range(30)] + [(3,)], "k int")
    got = {r.check: r for r in V.stacked([V.unique(df, "t", "u", ["k"]), V.rule(df, "t", "r", F.col("k") < 5, F.col("k"))]).collect()}
    assert (got["u"].violations, got["u"].sample) == (1, "3") and got["r"].violations == 25 and len(got["r"].sample.split(",")) == 10


def test_close_times_grow_over_bucket_edges(spark):
    closed = {8: 80, 9: 90, 10: 90, 11: 110, 19: 190, 20: 185, 21: 210, 45: 200, 46: 460}  # repeats at 10, falls at 20 and 45, with empty buckets before 45
    df = spark.createDataFrame([(s, c, 1, 100, str(s)) for s, c in closed.items()], "sequence bigint, closed_at bigint, transaction_count bigint, base_fee int, hash string")
    got = {r.check: r for r in V.check_ledgers(df, 10).collect()}["close_time_increasing"]
    assert (got.violations, got.sample) == (3, "10,20,45")


def test_issuers_and_native_identity(spark):
    assets = spark.createDataFrame([(0, 0, "", None), (1, 0, "", 1), (2, 1, "A", 1), (3, 1, "", 1), (4, 1, "B", None), (5, 1, "C", 9)], "id int, asset_type int, asset_code string, issuer_id int")
    accounts = spark.createDataFrame([(1,)], "account_id int")
    operations = spark.createDataFrame([(70, 2), (71, 5), (72, None)], "transaction_id int, asset_id int")
    balances = spark.createDataFrame([(1, i) for i in range(6)], "holder_id int, asset_id int")
    pools = spark.createDataFrame([(1, 0, 2), (2, 2, 5), (3, 5, 0)], "pool_id int, asset_a int, asset_b int")
    got = {(r.table, r.check): r["sample"] for r in V.check_issuers(operations, balances, pools, assets, accounts).collect()}
    assert got == {("operations", "issuer_exists"): "71", ("balances", "issuer_exists"): "1:5", ("balances", "identity_shape"): "1:1,1:3,1:4", ("pools", "asset_a_issuer_exists"): "3", ("pools", "asset_b_issuer_exists"): "2"}


def test_stored_minimums_are_recomputed(spark):
    positions = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "pool_id int, account_id int, first_deposit_ledger int")
    operations = spark.createDataFrame([(22, 1, 1, 5), (22, 1, 1, 9), (22, 2, 1, 4), (2, 1, 1, 1)], "type int, source_id int, pool_id int, ledger_sequence int")
    tokens = spark.createDataFrame([(1, 1, 3), (1, 2, None)], "contract_id int, token_id int, minted_at_ledger int")
    ownership = spark.createDataFrame([(1, 1, 3, 0), (1, 2, 3, 0), (1, 1, 1, 1)], "contract_id int, token_id int, ledger_sequence int, event_type int")
    contracts = spark.createDataFrame([(1, 7, 2), (2, 7, 3), (3, 8, 2), (4, None, 9)], "contract_id int, deployer_id int, deployed_at_ledger int")
    versions = spark.createDataFrame([(c, d, s) for c in (1, 2, 3, 4) for d, s in ((7, 2), (6, 4), (None, 1))], "contract_id int, deployer_id int, ledger_sequence int")
    accounts = spark.createDataFrame([(1, 0), (2, 5)], "account_id int, sequence_number int")
    got = {r.check: r["sample"] for r in V.check_stored_minimums(positions, operations, tokens, ownership, contracts, versions, accounts).collect()}
    assert got == {"first_deposit_is_least": "1:2", "minted_at_is_least": "1:2", "deployed_at_is_least": "2", "deployer_is_first": "3", "skeleton_rate": "50.0"}


def test_exact_percentiles_with_a_hot_key(spark):
    """One key with most of the rows, all values distinct: equal to percentile(), and its values lie in many ranges."""
    from orrery.functions.percentiles import exact_percentiles

    hot = spark.range(20_000).select(F.lit("hot").alias("k"), (F.xxhash64("id") % 1_000_000 / 7).alias("x"))
    few = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", None), (None, 5.0), (None, 5.0), (None, 6.0), ("c", 2.0)], "k string, x double")
    df = hot.unionByName(few)
    at = {"low": 0.0, "p50": 0.5, "p99": 0.99, "top": 1.0}
    want = {r.k: r for r in df.where("x is not null").groupBy("k").agg(*[F.percentile("x", q).alias(n) for n, q in at.items()]).collect()}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "x", at, partitions=16).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][n] - want[k][n]) < 1e-6 for k in want for n in at)
    assert exact_percentiles(df.where("false"), ["k"], "x", at).count() == 0
    plan = exact_percentiles(df, ["k"], "x", at, partitions=16)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower().replace("exact_percentiles", "")


def test_search_for_a_table_of_texts_equals_search_text_by_text(spark):
    import hashlib
    import random

    from orrery.operators import search as SE
    from orrery.operators import search_tables as ST

    rng = random.Random(8)
    code = lambda: "".join(rng.choice("aAbBx1/") for _ in range(rng.randrange(0, 7)))
    assets = spark.createDataFrame([(i, 0 if i == 0 else 1, "" if i == 0 else code(), i % 5) for i in range(60)], "id bigint, asset_type int, asset_code string, issuer_id bigint")
    pools = spark.createDataFrame([(i, hashlib.sha256(str(i).encode()).hexdigest(), i % 60, (i * 7) % 60, None if i % 9 == 0 else i) for i in range(80)], "pool_id bigint, pool_key string, asset_a bigint, asset_b bigint, created_ledger bigint")
    contracts = spark.createDataFrame([(i, "C" + "".join(rng.choice("ABC") for _ in range(55)), rng.choice([None, "", code(), "Straße Ab"])) for i in range(40)], "contract_id bigint, contract_key string, name string")
    wrappers = spark.createDataFrame([(i, i) for i in range(0, 60, 4)], "asset_id bigint, contract_id bigint")
    index = pools.select(F.col("pool_key").alias("hash"))
    texts = ["", "  ", "/", " / a", "a/b", "A / 1", "ab", "a", "XLM", "native", " x ", "aab", "1/1/1", "straße", "no such", "CA", "ca", "CAB", "C", "17", "G", hashlib.sha256(b"5").hexdigest().upper(), "b//", *[code() for _ in range(40)]]
    asked = ST.parsed(spark.createDataFrame([(t,) for t in texts + texts[:9] + [None]], "query string"))
    for one, many in [
        (SE.search_transactions(index, texts), ST.search_transactions(index, asked)),
        (SE.search_pools(pools, assets, texts), ST.search_pools(pools, assets, asked)),
        (SE.search_contracts(contracts, texts), ST.search_contracts(contracts, asked)),
        (SE.search_assets(assets, texts, wrappers), ST.search_assets(assets, asked, wrappers)),
    ]:
        assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
    many = ST.parsed(spark.range(10_000).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("query")))
    assert ST.search_assets(assets, many, wrappers).count() == sum(c in r.asset_code.lower() for r in assets.collect() for c in ("b1", "b11", "b111", "b1111"))


def test_texts_look_at_few_more_names_than_they_fit(spark):
    """Numbered names and as many texts: what postings bring near grows with the hits, not with texts times names."""
    from orrery.operators import search_tables as ST

    names = spark.range(4_000).select("id", F.concat(F.lit("brand#12p"), (F.col("id") + 100_000).cast("string")).alias("name"))
    asked = names.where("id % 2 = 0").select(F.col("name").alias("query"), F.array("name").alias("parts"))
    near = ST._containing(names, "id", [F.col("name")], asked, F.lit(True))
    assert 2_000 <= near.count() <= 4_000 and near.where("query = name").count() == 2_000
