import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.operators import reorg as R
from ledgerloom.operators import writers as W
from ledgerloom.plans import changelog as V
from ledgerloom.streaming.jobs import changelog_schema

EVENT = "0x" + "ab" * 32


def orphans(rows, marks):
    return sorted(r for r in rows if not any(m[0] == r[0] and m[1] > r[2] and m[2] <= r[1] for m in marks))


@pytest.mark.parametrize("seq_type", ["bigint", "decimal(38,0)", "double"])
@pytest.mark.parametrize("width", [1, 7, 64, 100000])
def test_invalidation_agrees_with_a_count_of_pairs(spark, seq_type, width):
    rng = random.Random(11)
    rows, marks = [], []
    for step in range(1500):
        # orders of several partitions are far apart and not dense
        seq = step * 10**15 + rng.randrange(1000) if seq_type == "decimal(38,0)" else step
        chain = 1 if rng.random() < 0.7 else 2
        block = step // 10 + rng.randint(-3, 3)
        if rng.random() < 0.02:
            marks.append((chain, seq, max(block - rng.randint(0, 60), 0)))
        else:
            rows.append((chain, block, seq))
    table = spark.createDataFrame([(c, b, str(s)) for c, b, s in rows], "chain_id bigint, block_number bigint, s string")
    reorgs = spark.createDataFrame([(c, str(s), b) for c, s, b in marks], "chain_id bigint, s string, from_block bigint")
    table = table.select("chain_id", "block_number", F.col("s").cast(seq_type).alias("seq"))
    reorgs = reorgs.select("chain_id", F.col("s").cast(seq_type).alias("seq"), "from_block")
    found = R.invalidate(table, reorgs, width)
    assert found.columns == table.columns
    want = orphans(rows, marks)
    assert sorted((r[0], r[1], int(r[2])) for r in found.collect()) == want
    assert 0 < len(want) < len(rows)


def test_invalidation_with_thousands_of_markers_and_arrival_order(spark):
    rng = random.Random(5)
    rows, marks, stamp = [], [], 1_700_000_000_000
    for step in range(9000):
        seq = (stamp + step) * 10**25 + rng.randrange(3) * 10**19 + step
        block = step // 2 + rng.randint(-40, 2)
        if rng.random() < 0.4:
            marks.append((1, seq, max(block - rng.randint(0, 20), 0)))
        else:
            rows.append((1, block, seq))
    as_text = lambda r, names: spark.createDataFrame([(a, b, str(c)) for a, b, c in r], names)
    order = F.col("s").cast("decimal(38,0)").alias("seq")
    table = as_text(rows, "chain_id bigint, block_number bigint, s string").select("chain_id", "block_number", order)
    reorgs = as_text([(c, b, s) for c, s, b in marks], "chain_id bigint, from_block bigint, s string").select("chain_id", order, "from_block")
    # a row survives if no later marker lies at or below its block
    want, best, at = [], {}, sorted(marks, key=lambda m: m[2])
    for block in sorted({r[1] for r in rows}):
        best[block] = max((m[1] for m in at if m[2] <= block), default=-1)
    want = sorted(r for r in rows if best[r[1]] < r[2])
    assert len(marks) > 3000 and want
    assert sorted((r[0], r[1], int(r[2])) for r in R.invalidate(table, reorgs).collect()) == want


def test_no_markers_keeps_everything(spark):
    table = spark.createDataFrame([(1, 5, 1)], "chain_id bigint, block_number bigint, seq bigint")
    none = spark.createDataFrame([], "chain_id bigint, seq bigint, from_block bigint")
    assert R.invalidate(table, none).count() == 1


def test_invalidation_plan(spark):
    table = spark.range(1000).selectExpr("id % 3 as chain_id", "id as block_number", "id as seq")
    marks = spark.createDataFrame([(1, 500, 400)], "chain_id bigint, seq bigint, from_block bigint")
    text = R.invalidate(table, marks)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    # the marker came at 500 and takes blocks 400 and above
    assert R.invalidate(table, marks).count() == 1000 - sum(i % 3 == 1 for i in range(400, 500))


HASHES = "chain_id bigint, block_number bigint, block_hash string"


@pytest.mark.parametrize(
    "stored, node, last, want",
    [
        # tip equal, even in another case
        ({1: "0xa", 2: "0xb"}, {1: "x", 2: "0xB"}, 2, ("ok", None, 2)),
        # tip differs, fork right below
        ({1: "0xa", 2: "0xb"}, {1: "0xA", 2: "0xc"}, 2, ("reorg", 2, 1)),
        # a hole in the stored blocks is skipped
        ({1: "0xa", 4: "0xb"}, {1: "0xa", 2: "z", 3: "z", 4: "0xc"}, 4, ("reorg", 2, 1)),
        # nothing in common: from 0, watermark cleared
        ({0: "0xa", 1: "0xb"}, {0: "0xx", 1: "0xy"}, 1, ("reorg", 0, None)),
        # the node lacks the tip
        ({1: "0xa", 2: "0xb"}, {1: "0xa"}, 2, ("unavailable", None, 2)),
        # the node lacks a block above the fork
        ({1: "0xa", 2: "0xb", 3: "0xc"}, {1: "0xa", 3: "0xd"}, 3, ("unavailable", None, 3)),
        # the node lacks a block below the fork only
        ({1: "0xa", 2: "0xb", 3: "0xc"}, {2: "0xb", 3: "0xd"}, 3, ("reorg", 3, 2)),
        # nothing stored up to the watermark: no check
        ({3: "0xa"}, {2: "0xz"}, 2, None),
        # no stored tip: no check
        ({1: "0xa"}, {1: "0xz"}, 2, None),
        # blocks above the watermark are ignored
        ({1: "0xa", 2: "0xb", 3: "0xc"}, {1: "0xa", 2: "0xb", 3: "0xd"}, 2, ("ok", None, 2)),
    ],
)
def test_detect(spark, stored, node, last, want):
    def blocks(found):
        return spark.createDataFrame([(1, b, h) for b, h in found.items()], HASHES)

    state = spark.createDataFrame([(1, last)], "chain_id bigint, last_processed_block bigint")
    row = R.detect(blocks(stored), blocks(node), state).first()
    if want is None:
        assert row.status == "unchecked" and row.from_block is None
    else:
        assert (row.status, row.from_block, row.last_processed_block) == want
        assert R.reorg_messages(R.detect(blocks(stored), blocks(node), state)).count() == (want[0] == "reorg")


# --- views against a replay in order ----------------------------------------------------------


def random_messages(rng):
    """A short list of messages of two chains with duplicates, moves and reorgs."""
    messages, head = [], {1: 0, 2: 0}
    for _ in range(rng.randint(5, 40)):
        chain = rng.choice([1, 2])
        roll = rng.random()
        if messages and roll < 0.15:
            messages.append(dict(rng.choice(messages)))
        elif roll < 0.28:
            start = max(head[chain] - rng.randint(0, 4), 0)
            messages.append({"kind": "reorg", "chain_id": chain, "from_block": start})
            head[chain] = start
        else:
            block = max(head[chain] + rng.choice([0, 0, 1]), 0)
            head[chain] = block
            version = rng.choice("ab")
            messages.append({
                "kind": rng.choice([S.LOG, S.BLOCK, S.TRANSACTION, S.RECEIPT]),
                "chain_id": chain, "block_number": block, "block_hash": f"0x{block}{version}",
                "tx_hash": f"0x{rng.randint(0, 3)}", "log_index": rng.randint(0, 1),
                "topics": [EVENT, "0x" + f"{rng.randint(1, 3):064x}"],
                "data": "0x" + f"{rng.randint(0, 9):064x}", "nonce": rng.randint(0, 99),
                "gas_limit": rng.randint(0, 99),
            })
    return messages


def replay(messages):
    """What a sequential consumer holds after the list."""
    tables = {S.LOG: {}, S.BLOCK: {}, S.TRANSACTION: {}, S.RECEIPT: {}}
    state = {}
    for m in messages:
        chain = m["chain_id"]
        if m["kind"] == "reorg":
            for rows in tables.values():
                for key in [k for k, r in rows.items() if r["chain_id"] == chain and r["block_number"] >= m["from_block"]]:
                    del rows[key]
            state.pop(chain, None)
            if m["from_block"]:
                state[chain] = m["from_block"] - 1
            continue
        state[chain] = max(state.get(chain, 0), m["block_number"])
        rows = tables[m["kind"]]
        if m["kind"] == S.LOG:
            key = (chain, m["block_hash"], m["block_number"], m["tx_hash"], m["log_index"])
            rows.setdefault(key, m)
        elif m["kind"] == S.BLOCK:
            rows[(chain, m["block_number"])] = m
        else:
            rows[(chain, m["tx_hash"])] = m
    return tables, state


def test_views_equal_a_replay_in_order(spark):
    """200 seeded lists at once: each list gets chains of its own."""
    rng = random.Random(5)
    schema = changelog_schema()
    zero = {"string": "", "bigint": 0, "int": 0, "boolean": False, "array<string>": []}
    rows, want, want_state, want_balance = [], {k: set() for k in (S.LOG, S.BLOCK, S.TRANSACTION, S.RECEIPT)}, {}, {}
    for run in range(200):
        messages = random_messages(rng)
        for m in messages:
            m["chain_id"] += 10 * run
        for seq, m in enumerate(messages):
            values = {**m, "seq": seq, "type": m["kind"], "block_gas_limit": m.get("gas_limit", 0)}
            rows.append(tuple(
                values.get(f.name, None if f.name in ("raw", "dead_stage", "dead_reason", "message_time")
                           else zero.get(f.dataType.simpleString())) for f in schema.fields
            ))
        tables, state = replay(messages)
        want_state.update(state)
        for r in tables[S.LOG].values():
            want[S.LOG].add((r["chain_id"], r["block_number"], r["block_hash"], r["tx_hash"], r["log_index"], r["data"]))
            amount, address = int(r["data"], 16), "0x" + r["topics"][1][26:]
            if amount:
                key = (r["chain_id"], address)
                want_balance[key] = want_balance.get(key, 0) + amount
        for r in tables[S.BLOCK].values():
            want[S.BLOCK].add((r["chain_id"], r["block_number"], r["block_hash"], r["gas_limit"]))
        for r in tables[S.TRANSACTION].values():
            want[S.TRANSACTION].add((r["chain_id"], r["tx_hash"], r["block_number"], r["nonce"]))
        for r in tables[S.RECEIPT].values():
            want[S.RECEIPT].add((r["chain_id"], r["tx_hash"], r["block_number"]))
    log = spark.createDataFrame(rows, schema).repartition(4)

    def got(df, *columns):
        found = [tuple(r) for r in df.select(*columns).collect()]
        assert len(found) == len(set(found))
        return set(found)

    assert got(V.logs(log), "chain_id", "block_number", "block_hash", "tx_hash", "log_index", "data") == want[S.LOG]
    assert got(V.blocks(log), "chain_id", "block_number", "block_hash", "gas_limit") == want[S.BLOCK]
    assert got(V.transactions(log), "chain_id", "tx_hash", "block_number", "nonce") == want[S.TRANSACTION]
    assert got(V.receipts(log), "chain_id", "tx_hash", "block_number") == want[S.RECEIPT]
    assert dict(map(tuple, V.state(log).select("chain_id", "last_processed_block").collect())) == want_state
    balances = {(r.chain_id, r.address): int(r.balance) for r in V.balances(log, EVENT).collect()}
    assert balances == want_balance


def test_writers_and_state(spark):
    rows = [(1, "k", 3, "c"), (1, "k", 1, "a"), (1, "k", 2, "b"), (2, "k", 5, "z")]
    df = spark.createDataFrame(rows, "chain_id bigint, key string, seq bigint, v string")
    last = {r.chain_id: r.v for r in W.last_writer(df, ["chain_id", "key"]).collect()}
    first = {r.chain_id: r.v for r in W.first_writer(df, ["chain_id", "key"]).collect()}
    assert (last, first) == ({1: "c", 2: "z"}, {1: "a", 2: "z"})
    new = W.insert_ignore(df.where("chain_id = 2"), df, ["chain_id", "key"])
    assert [(r.chain_id, r.v) for r in new.collect()] == [(1, "a")]
    state = spark.createDataFrame([(1, 9), (2, 8)], "chain_id bigint, last_processed_block bigint")
    assert [r.chain_id for r in W.clear_state(state, [1]).collect()] == [2]


def test_evolve(spark):
    old = spark.createDataFrame([(1,)], "a int")
    assert W.evolve(old, "b", "bigint", 7).first().b == 7
    assert W.evolve(old, "a", "int", 0).first().a == 1
    new = spark.createDataFrame([(2, 5)], "a int, b bigint")
    merged = {r.a: r.b for r in W.union_evolved(old, new, {"b": 0}).collect()}
    assert merged == {1: 0, 2: 5}


def test_normalise(spark):
    row = W.normalise_transactions(spark.sql(
        "select '0xAB' tx_hash, '0xCD' block_hash, '0xEF' from_addr, '' to_addr, '' value, '5' gas_price, '0xAb' input"
    )).first()
    assert tuple(row) == ("0xab", "0xcd", "0xef", None, "0", "5", "0xAb")


def test_delete_from(spark):
    df = spark.range(6).select((F.col("id") % 2).alias("chain_id"), F.col("id").alias("block_number"))
    left = sorted(tuple(r) for r in W.delete_from(df, 1, 3).collect())
    assert left == [(0, 0), (0, 2), (0, 4), (1, 1)]
