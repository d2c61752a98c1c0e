"""Stored tables, the folded changelog and the index against a replay of the whole changelog, with crashes in between."""

import random
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ledgerloom.operators import filters as Q
from ledgerloom.plans import changelog as V
from ledgerloom.plans import queries as P
from ledgerloom.session import scratch_path
from ledgerloom.sources import topics
from ledgerloom.streaming import compaction, entities, jobs, manifest
from test_streaming import land

WIDTH = 10
VIEWS = {"logs": V.logs, "blocks": V.blocks, "transactions": V.transactions, "receipts": V.receipts}


def word(n, digits=64):
    return "0x" + f"{n:x}".rjust(digits, "0")


def history(rng, batches, size):
    """Batches of messages: repeated deliveries, transactions that move, reorgs, and rows that come back after them."""
    made = []
    for _ in range(batches):
        rows = []
        for _ in range(size):
            chain, block, tx = rng.choice([1, 2]), rng.randrange(45), rng.randrange(12)
            base = {"chain_id": chain, "block_number": block, "block_hash": word(block + 100 * rng.randrange(2)), "tx_hash": word(tx).upper().replace("X", "x")}
            kind = rng.choice(["block", "log", "transaction", "receipt", "transaction", "log"])
            if rng.random() < 0.04:
                rows.append({"type": "reorg", "chain_id": chain, "from_block": rng.randrange(15, 45)})
            elif kind == "block":
                rows.append({"type": kind, "tx_count": rng.randrange(9), **{k: v for k, v in base.items() if k != "tx_hash"}})
            elif kind == "log":
                rows.append({"type": kind, **base, "log_index": rng.randrange(3), "address": word(tx, 40), "data": word(5), "topics": [word(1)]})
            elif kind == "transaction":
                rows.append({"type": kind, **base, "tx_index": rng.randrange(3), "from": word(rng.randrange(9), 40), "to": word(rng.randrange(9), 40), "value": "7", "nonce": rng.randrange(9)})
            else:
                rows.append({"type": kind, **base, "tx_index": 0, "status": rng.randrange(2)})
        made.append(rows)
    return made


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(set(df.columns) - {"block_bucket"})).collect()))


def stream(spark, source, path, offsets, after):
    rows = topics.read_files(spark, source, [1, 2], prefix="t", max_files_per_trigger=1)
    jobs.start_changelog(rows, path, offsets, after_batch=after, width=WIDTH).awaitTermination()


@pytest.fixture(scope="module")
def stored(spark):
    """Tables after a stream of 5 batches whose jobs crashed before, between and after their steps, folded as it went."""
    source, path, offsets, root, plain = (scratch_path(spark, n) for n in ("in", "log", "offsets", "tables", "plain"))
    crashes = {1: ["before"], 2: ["manifest"], 3: ["fold"], 4: ["after"]}
    commit, sizes = manifest.commit, []

    def after(session, batch_id):
        def crash(where):
            if where in crashes.get(batch_id, []):
                crashes[batch_id].remove(where)
                raise RuntimeError(f"lost {where}")

        crash("before")
        jobs.store_batch(jobs.read_changelog(session, path).where(F.col("batch_id") == batch_id).drop("batch_id", "block_bucket"), batch_id, plain, WIDTH)
        jobs.fold_changelog(session, path, batch_id, fan=2)
        crash("fold")

        def commit_or_die(*args):
            if args[1] == root:
                crash("manifest")
            commit(*args)

        manifest.commit = commit_or_die
        try:
            entities.refresh(session, path, batch_id, root, WIDTH)
        finally:
            manifest.commit = commit
        crash("after")
        sizes.append(len(compaction.segments(session, path)) + len(compaction.batches(session, path)))

    old_fan, entities.FAN = entities.FAN, 2
    for number, batch in enumerate(history(random.Random(4), 5, 90)):
        land(spark, source, batch, number)
        for _ in range(4):
            try:
                stream(spark, source, path, offsets, after)
                break
            except StreamingQueryException:
                continue
        else:
            raise AssertionError("the stream did not recover")
    entities.FAN = old_fan
    assert not any(crashes.values())
    return path, root, plain, sizes


def test_tables_equal_a_replay(spark, stored):
    path, root, plain, _ = stored
    whole = jobs.read_changelog(spark, plain)
    assert whole.count() == jobs.read_changelog(spark, path).count() == 5 * 90
    for name, view in VIEWS.items():
        found = rows_of(entities.read(spark, root, name))
        assert found == rows_of(view(whole)) and found, name


def test_a_batch_writes_only_folders_it_touches(spark, stored):
    _, root, _, _ = stored
    _, entries = manifest.live(spark, root)
    made = {e["version"] for e in entries if e["table"] == "blocks"}
    assert len(made) > 1 and max(made) <= entities.STEP * 4


def test_folding_keeps_the_listing_short(spark, stored):
    path, _, plain, sizes = stored
    assert len(compaction.batches(spark, plain)) == 5
    # segments of 2 and of 4 batches, and the batches not folded yet or replaced by the last fold
    assert max(sizes) <= 6 and len(compaction.segments(spark, path)) >= 1
    read = jobs.read_changelog(spark, path).where("kind = 'log' and chain_id = 1 and block_bucket >= 3")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("block_bucket") and re.search(r"PartitionFilters: \[[^\]]*block_bucket#\d+L >= 3", plan)


def test_a_fold_that_died_loses_nothing(spark, stored):
    path, _, plain, _ = stored
    before = rows_of(jobs.read_changelog(spark, path))
    commit, schema = manifest.commit, jobs.changelog_schema()
    manifest.commit = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError):
            compaction.fold(spark, plain, schema, 4, fan=2)
    finally:
        manifest.commit = commit
    assert rows_of(jobs.read_changelog(spark, plain)) == before
    assert compaction.fold(spark, plain, schema, 4, fan=2) == 3
    assert [(s["first"], s["last"], s["level"]) for s in compaction.segments(spark, plain)] == [(0, 3, 1)]
    assert rows_of(jobs.read_changelog(spark, plain)) == before


def test_index_opens_the_folders_that_hold_a_value(spark, stored):
    _, root, plain, _ = stored
    whole = V.logs(jobs.read_changelog(spark, plain))
    address = word(3, 40)
    found = entities.read(spark, root, "logs", holding=address, fields=("address",))
    held = whole.where(F.col("address") == address)
    assert rows_of(found.where(F.col("address") == address)) == rows_of(held)
    opened = {re.search(r"chain_id=(\d+)/block_bucket=(\d+)", f).groups() for f in found.inputFiles()}
    assert opened == {(str(r[0]), str(r[1] // WIDTH)) for r in held.select("chain_id", "block_number").distinct().collect()}
    assert entities.read(spark, root, "logs", holding=word(999, 40)).count() == 0
    wanted = Q.TransactionFilter(address=word(4, 40), limit=1000)
    sender = entities.read(spark, root, "transactions", holding=wanted.address, fields=("from_addr", "to_addr"))
    assert rows_of(P.transactions(sender, wanted)) == rows_of(P.transactions(V.transactions(jobs.read_changelog(spark, plain)), wanted))


def test_bounds_choose_folders_before_any_file_is_listed(spark, stored):
    _, root, plain, _ = stored
    some = entities.read(spark, root, "blocks", chain_id=2, from_block=20, to_block=29, width=WIDTH)
    assert {re.search(r"chain_id=(\d+)/block_bucket=(\d+)", f).groups() for f in some.inputFiles()} <= {("2", "2")}
    expected = V.blocks(jobs.read_changelog(spark, plain)).where("chain_id = 2 and block_number between 20 and 29")
    assert rows_of(some) == rows_of(expected)


def test_rebuild_from_a_block_and_vacuum(spark, stored):
    path, root, plain, _ = stored
    before = {name: rows_of(entities.read(spark, root, name)) for name in VIEWS}
    version, entries = manifest.live(spark, root)
    # a folder that was damaged: a replay from its block on makes it anew
    broken = max((e for e in entries if e["table"] == "blocks"), key=lambda e: e["bucket"])
    chain, first = broken["chain"], broken["bucket"]
    manifest.commit(spark, root, version, [e for e in entries if e is not broken])
    assert rows_of(entities.read(spark, root, "blocks")) != before["blocks"]
    entities.rebuild(spark, path, root, chain, first * WIDTH, WIDTH)
    assert {name: rows_of(entities.read(spark, root, name)) for name in VIEWS} == before
    _, after = manifest.live(spark, root)
    assert all(e["chain"] == chain and e["bucket"] >= first for e in after if e.get("version") == version + 1)
    for _ in range(manifest.KEPT_VERSIONS + 1):
        entities.rebuild(spark, path, root, 1, 40, WIDTH)
    assert entities.vacuum(spark, root) > 0
    assert {name: rows_of(entities.read(spark, root, name)) for name in VIEWS} == before


def test_tables_that_no_batch_has_reached(spark):
    root = scratch_path(spark, "nothing")
    assert entities.read(spark, root, "logs", holding=word(1, 40)).count() == 0
    assert entities.read(spark, root, "blocks", chain_id=1).columns[-1] == "block_bucket"
    assert entities.vacuum(spark, root) == 0 and manifest.live(spark, root) == (-1, [])
