"""Readers, buckets, swaps and the live tail, on temporary folders."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from orrery.sources import records as S
from orrery.streaming import live as L


def test_read_records_with_fixed_schema(spark, tmp_path):
    (tmp_path / "ledgers").mkdir()
    (tmp_path / "ledgers" / "a.json").write_text(json.dumps({"sequence": 7, "hash": "ab", "extra": 1}) + "\n")
    row = S.read_records(spark, str(tmp_path), "ledgers", "json").first()
    assert (row.sequence, row.hash, row.base_fee) == (7, "ab", None) and "extra" not in row
    spark.range(3).select(F.col("id").cast("int").alias("sequence")).write.parquet(str(tmp_path / "p" / "ledgers"))
    assert S.read_records(spark, str(tmp_path / "p"), "ledgers").count() == 3


def test_prune_reads_only_touched_buckets(spark, tmp_path):
    S.write_bucketed(spark.range(0, 1000).select(F.col("id").cast("int").alias("ledger_sequence")), str(tmp_path / "t"), size=100)
    df = S.prune(spark.read.parquet(str(tmp_path / "t")), 150, 249, size=100)
    assert df.count() == 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ledger_bucket" in plan[plan.index("PartitionFilters") :] and len(df.inputFiles()) >= 2


def test_rebuild_and_swap_may_read_its_target(spark, tmp_path):
    target = str(tmp_path / "t")
    assert S.rebuild_and_swap(spark.range(5), target) == 5
    more = spark.read.parquet(target).unionByName(spark.range(5, 8))
    assert S.rebuild_and_swap(more, target, dry_run=True) == 8 and spark.read.parquet(target).count() == 5
    assert S.rebuild_and_swap(more, target) == 8 and spark.read.parquet(target).count() == 8
    assert os.listdir(tmp_path) == ["t"]


def test_writes_again_change_nothing(spark, tmp_path):
    tables = {"ledgers": spark.range(1, 4).select(F.col("id").alias("sequence")), "transactions": spark.range(1, 4).select(F.col("id").alias("ledger_sequence"), "id")}
    for _ in range(2):
        L.write_ledger_batch(tables, str(tmp_path), 10)
    assert spark.read.parquet(str(tmp_path / "ledgers")).count() == 3 and spark.read.parquet(str(tmp_path / "transactions")).count() == 3


def test_live_tail_stops_at_a_gap_and_goes_on_later(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(*sequences):
        for s in sequences:
            (source / f"{s}.json").write_text(json.dumps({"sequence": s, "tx": s * 10}) + "\n")

    def run():
        fold = lambda batch: {"ledgers": batch.select("sequence"), "transactions": batch.select(F.col("sequence").alias("ledger_sequence"), "tx")}
        L.live_tail(spark, str(source), root, "sequence bigint, tx bigint", fold, str(tmp_path / "checkpoint"), start=4, size=10).awaitTermination()
        return sorted(r.sequence for r in spark.read.parquet(f"{root}/ledgers").collect())

    put(6, 5, 9)
    assert run() == [5, 6]
    put(7, 12)
    assert run() == [5, 6, 7]
    put(8)
    assert run() == [5, 6, 7, 8, 9]
    assert sorted(r.tx for r in spark.read.parquet(f"{root}/transactions").collect()) == [50, 60, 70, 80, 90]


def test_live_tail_keeps_all_rows_of_a_ledger(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(name, *rows):
        (source / f"{name}.json").write_text("".join(json.dumps({"sequence": s, "tx": t}) + "\n" for s, t in rows))

    def run():
        fold = lambda batch: {"ledgers": batch.select("sequence").distinct(), "transactions": batch.select(F.col("sequence").alias("ledger_sequence"), "tx")}
        L.live_tail(spark, str(source), root, "sequence bigint, tx bigint", fold, str(tmp_path / "checkpoint"), size=10).awaitTermination()
        waits = spark.read.schema("sequence bigint, tx bigint").option("recursiveFileLookup", "true").parquet(f"{root}/_waiting")
        return sorted(r.tx for r in spark.read.parquet(f"{root}/transactions").collect()), sorted(r.tx for r in waits.collect())

    put("a", (1, 10), (1, 11), (2, 20), (2, 21), (4, 40), (4, 41), (1, 10))
    assert run() == ([10, 11, 20, 21], [40, 41])
    put("b", (6, 60), (1, 10))
    assert run() == ([10, 11, 20, 21], [40, 41, 60])
    put("c", (3, 30), (3, 31), (5, 50))
    assert run() == ([10, 11, 20, 21, 30, 31, 40, 41, 50, 60], [])


class Killed(BaseException):
    """Stands for the end of the process."""


def ledger_tables(spark, lo, hi, fee=1):
    ids = spark.range(lo, hi + 1)
    both = ids.select(F.col("id").alias("ledger_sequence"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"), F.lit(fee).alias("fee"))
    return {"ledgers": ids.select(F.col("id").alias("sequence")), "transactions": both, "events": both.drop("fee")}


def stored(spark, root, name="transactions", column="ledger_sequence"):
    folder = f"{root}/{name}"
    return sorted(tuple(r) for r in spark.read.parquet(folder).select(column, "n", "fee").collect()) if os.path.isdir(folder) else []


def test_a_batch_that_dies_at_any_step_is_whole_after_the_retry(spark, tmp_path, monkeypatch):
    """The process ends before each single file operation in turn: between two files of one table too."""
    whole = sorted((s, n, 1) for s in range(1, 31) for n in (1, 2, 3))
    real, died = L._fs, 0
    for step in range(0, 200, 4):
        root, left = str(tmp_path / f"r{step}"), [step]
        L.write_ledger_batch(ledger_tables(spark, 1, 5), root, 10) if step % 8 == 0 else os.makedirs(root)

        def counted(session, path):
            if path.startswith(root):
                left[0] -= 1
                if left[0] < 0:
                    raise Killed
            return real(session, path)

        monkeypatch.setattr(L, "_fs", counted)
        try:
            L.write_ledger_batch(ledger_tables(spark, 1, 30), root, 10)
            ended = True
        except Killed:
            ended, died = False, died + 1
        monkeypatch.setattr(L, "_fs", real)
        if not ended:  # readers go by the marker: a ledger that it has is whole
            marked = {r[0] for r in spark.read.parquet(f"{root}/ledgers").select("sequence").collect()} if os.path.isdir(f"{root}/ledgers") else set()
            held = stored(spark, root)
            assert {s for s, _, _ in held if s in marked} == marked and all((s, n, 1) in held for s in marked for n in (1, 2, 3))
            L.write_ledger_batch(ledger_tables(spark, 1, 30), root, 10)
        assert stored(spark, root) == whole
        assert not os.path.exists(f"{root}/_staged") or not os.listdir(f"{root}/_staged")
        if ended:
            break
    assert died >= 5


def test_batches_are_sorted_and_pruned(spark, tmp_path):
    L.write_ledger_batch(ledger_tables(spark, 1, 40), str(tmp_path), 10)
    for folder in sorted(os.listdir(tmp_path / "transactions")):
        for file in (tmp_path / "transactions" / folder).glob("*.parquet"):
            own = [r[0] for r in spark.read.parquet(str(file)).select("ledger_sequence").collect()]
            assert own == sorted(own) and len({s // 10 for s in own}) == 1


def test_ledgers_are_written_anew_in_place(spark, tmp_path):
    root = str(tmp_path)
    L.write_ledger_batch(ledger_tables(spark, 1, 25), root, 10)
    L.write_ledger_batch(ledger_tables(spark, 8, 12, fee=7), root, 10, replace=True)
    assert stored(spark, root) == sorted((s, n, 7 if 8 <= s <= 12 else 1) for s in range(1, 26) for n in (1, 2, 3))
    assert sorted(r[0] for r in spark.read.parquet(f"{root}/ledgers").select("sequence").collect()) == list(range(1, 26))


def test_late_records_are_kept_apart_and_counted_once(spark, tmp_path):
    source, root, schema = tmp_path / "in", str(tmp_path / "out"), "sequence bigint, tx bigint"
    source.mkdir()

    def put(name, *rows):
        (source / f"{name}.json").write_text("".join(json.dumps({"sequence": s, "tx": t}) + "\n" for s, t in rows))

    def run():
        fold = lambda batch: {"ledgers": batch.select("sequence").distinct(), "transactions": batch.select(F.col("sequence").alias("ledger_sequence"), "tx")}
        L.live_tail(spark, str(source), root, schema, fold, str(tmp_path / "checkpoint"), size=10).awaitTermination()

    put("a", (1, 10), (2, 20))
    run()
    assert L.late_records(spark, root, schema).count() == 0
    put("b", (2, 21), (3, 30), (5, 50))
    run()
    assert sorted((r.sequence, r.tx) for r in L.late_records(spark, root, schema).collect()) == [(2, 21)]
    assert sorted(r.tx for r in spark.read.parquet(f"{root}/transactions").collect()) == [10, 20, 30]
    # the process ended behind the commit, before the stream knew: the same batch comes again
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    run()
    assert sorted((r.sequence, r.tx) for r in L.late_records(spark, root, schema).collect()) == [(2, 21)]
    assert sorted(r.tx for r in spark.read.parquet(f"{root}/transactions").collect()) == [10, 20, 30]


def test_readers_see_a_version_at_all_times(spark, tmp_path):
    import threading

    target, seen, failed, over = str(tmp_path / "t"), [], [], threading.Event()
    S.publish_version(spark.range(100).select(F.lit(0).alias("v")), target)

    def read():
        while not over.is_set():
            try:
                seen.append({r.v for r in S.read_version(spark, target, "v int").collect()})
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 11):
        S.publish_version(S.read_version(spark, target, "v int").select((F.col("v") + 1).alias("v")), target)
    over.set()
    reader.join()
    assert not failed and all(len(s) == 1 for s in seen) and [min(s) for s in seen] == sorted(min(s) for s in seen)
    assert S.read_version(spark, target).first().v == 10 and S.read_version(spark, target, back=2).first().v == 8
    assert len(os.listdir(f"{target}/versions")) == S.KEPT
    assert S.publish_version(spark.range(3), target, dry_run=True) == 3 and S.read_version(spark, target).count() == 100


def test_a_version_that_dies_on_its_way_changes_nothing(spark, tmp_path, monkeypatch):
    target, real = str(tmp_path / "t"), S._fs
    S.publish_version(spark.range(5), target)

    def dies(session, path):
        if "/pointers/" in path:
            raise Killed
        return real(session, path)

    monkeypatch.setattr(S, "_fs", dies)
    try:
        S.publish_version(spark.range(9), target)
        raise AssertionError
    except Killed:
        pass
    monkeypatch.setattr(S, "_fs", real)
    assert S.read_version(spark, target).count() == 5 and len(os.listdir(f"{target}/versions")) == 2
    monkeypatch.setattr(S, "IN_THE_MAKING_MS", -10_000)  # what a dead job left goes when it is old
    S.publish_version(spark.range(7), target)
    assert S.read_version(spark, target).count() == 7 and len(os.listdir(f"{target}/versions")) == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    target, real = str(tmp_path / "t"), S._pointers
    S.publish_version(spark.range(5), target)
    before = real(spark, target)
    S.publish_version(spark.range(6), target)
    answers = [before]  # another job published after this one had looked
    monkeypatch.setattr(S, "_pointers", lambda *a: answers.pop() if answers else real(*a))
    try:
        S.publish_version(spark.range(7), target)
        raise AssertionError
    except OSError:
        pass
    assert S.read_version(spark, target).count() == 6


def test_lag_is_not_negative(spark):
    df = spark.sql("SELECT 1 AS sequence, TIMESTAMP '2024-01-01 00:00:10' AS closed_at UNION ALL SELECT 2, TIMESTAMP '2024-01-01 00:01:00'")
    assert sorted(r.lag_seconds for r in L.ingestion_lag(df, "2024-01-01 00:00:30").collect()) == [0, 20]


def test_progress(spark):
    done = spark.createDataFrame([(1,), (2,), (2,), (5,)], "sequence bigint")
    assert [r.sequence for r in L.missing_ledgers(done, 1, 6).orderBy("sequence").collect()] == [3, 4, 6]
    assert sorted((r.part, r.indexed, r.pending) for r in L.progress_by_partition(done, 0, 7, 4).collect()) == [(0, 2, 2), (1, 1, 3)]


def scans(df):
    """Partitions and files that each scan of a finished query read."""
    df.collect()
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            return walk(node.plan())
        metrics = node.metrics()
        if metrics.contains("numPartitions") and metrics.contains("numFiles"):
            found.append((metrics.apply("numPartitions").value(), metrics.apply("numFiles").value()))
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_hash_lookups_prune_the_scan_of_events(spark, tmp_path, monkeypatch):
    from orrery.operators import reads

    events = spark.range(20_000).selectExpr("id AS transaction_id", "CAST(id / 10 AS BIGINT) AS ledger_sequence", "id AS event_index", "id AS contract_id", "'s' AS signature", "'d' AS data")
    S.write_bucketed(events, str(tmp_path / "e"), 100)
    spark.range(20_000).selectExpr("sha2(CAST(id AS STRING), 256) AS hash", "id AS transaction_id", "CAST(id / 10 AS BIGINT) AS ledger_sequence").write.parquet(str(tmp_path / "i"))
    asked = [5_003, 5_500, 17_000]
    spark.createDataFrame([(k,) for k in asked], "id bigint").selectExpr("sha2(CAST(id AS STRING), 256) AS hash").union(spark.sql("SELECT 'no hash'")).write.parquet(str(tmp_path / "h"))
    e, i, h = (spark.read.parquet(str(tmp_path / n)) for n in "eih")
    for pushed in (reads.PUSHED_LEDGERS, 1):  # by ledgers and buckets, and by buckets alone
        monkeypatch.setattr(reads, "PUSHED_LEDGERS", pushed)
        df = reads.events_by_tx_hash(e, i, h, 100)
        assert sorted(r.transaction_id for r in df.collect()) == asked
        assert min(parts for parts, _ in scans(df)) == 2  # of 20 buckets
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("In(ledger_sequence" in plan) == (pushed > 1)
    assert sorted(r.transaction_id for r in reads.events_by_tx_hash(e, i, h).collect()) == asked
    assert reads.events_by_tx_hash(e, i, h.where("false"), 100).count() == 0


def test_pages_by_descent_equal_the_full_sort_and_read_few_buckets(spark, tmp_path):
    import random

    from orrery.functions.versioned import keyset_page
    from orrery.sources.bucketed import bucket_page, buckets_of

    rng, size = random.Random(4), 100
    rows = [(s, k, rng.randrange(50)) for s in rng.sample(range(3_000), 700) for k in range(rng.randrange(1, 5))]
    df = spark.createDataFrame([r for r in rows if not 900 <= r[0] < 1_700], "ledger_sequence bigint, k bigint, who bigint")
    S.write_bucketed(df, str(tmp_path / "t"), size)
    facts, buckets = spark.read.parquet(str(tmp_path / "t")), buckets_of(spark, str(tmp_path / "t"))
    whole, key = df.cache(), ["ledger_sequence", "k"]
    for cursor, backward, descending, limit, who in [(None, False, True, 20, None), ((1_750, 2), False, True, 30, None), ((950, 0), True, True, 15, None), ((2_999, 9), True, True, 5, None), ((40, 1), False, True, 500, None), (None, False, False, 7, 3), ((1_800, 0), False, True, 4, 7), ((0, 0), False, True, 3, 99)]:
        build = (lambda f: f) if who is None else (lambda f, who=who: f.where(F.col("who") == who))
        want = [tuple(r) for r in keyset_page(build(whole), key, limit, cursor, backward, descending).collect()]
        page = bucket_page(facts, buckets, key, limit, cursor, backward, descending, size, build)
        assert [tuple(r) for r in page.drop("ledger_bucket").collect()] == want
        if who is None and limit <= 30 and want:
            assert max(parts for parts, _ in scans(page)) <= 3
    assert bucket_page(facts, [], key, 5, size=size).count() == 0
