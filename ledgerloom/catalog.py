"""Every operator as a query over the fixture views."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixtures as X
from ledgerloom import schemas as S
from ledgerloom.fixtures import BUCKET_WIDTH, CHAINS, EVENT_A, EVENT_N, Fixtures
from ledgerloom.functions.fields import event_matches
from ledgerloom.operators import aggregates as A
from ledgerloom.operators import balances as B
from ledgerloom.operators import completeness as C
from ledgerloom.operators import continuity as N
from ledgerloom.operators import filters as Q
from ledgerloom.operators import messages as M
from ledgerloom.operators import metrics as K
from ledgerloom.operators import reorg as R
from ledgerloom.operators import writers as W
from ledgerloom.plans import changelog as V
from ledgerloom.plans import ingest as I
from ledgerloom.plans import queries as P
from ledgerloom.plans import reorg_search
from ledgerloom.session import scratch_path
from ledgerloom.sources import rpc, tables, topics
from ledgerloom.streaming import entities, jobs, publish

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Parameters of the filtered queries.
SUPPLIER = "0x" + "7".rjust(40, "0")
RECIPIENT = "0x" + "F426A".rjust(40, "0")
PREFIX = topics.TOPIC_PREFIX


def query(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
    return build


def _text_topics(df: DataFrame) -> DataFrame:
    return df.withColumn("topics", F.array_join("topics", ","))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _inventory(found: dict[str, DataFrame]) -> DataFrame:
    """(source, chain_id, block_number, item) over several tables."""
    item = {"logs": F.concat_ws(":", "tx_hash", "log_index"), "blocks": F.col("block_hash")}
    return _union([
        df.select(F.lit(name).alias("source"), "chain_id", "block_number",
                  item.get(name, F.col("tx_hash")).alias("item"))
        for name, df in found.items()
    ])


def _tables(fx: Fixtures) -> dict[str, DataFrame]:
    return {"logs": fx.logs, "blocks": fx.blocks, "transactions": fx.transactions, "receipts": fx.receipts}


def _as_messages(encoded: DataFrame) -> DataFrame:
    """Encoded rows as they would be read back from a topic."""
    return M.decode(
        encoded.select(
            "topic", F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
            X.processed_at().alias("timestamp"), F.col("value"),
        )
    )


# --- sources --------------------------------------------------------------------------------


@query
def src_rpc_blocks(fx):
    return rpc.valid(rpc.blocks(rpc.read_landed(fx.spark, fx.land_blocks())))


@query
def src_rpc_transactions(fx):
    return rpc.valid(rpc.transactions(rpc.read_landed(fx.spark, fx.land_blocks())))


@query
def src_rpc_receipts(fx):
    return rpc.valid(rpc.receipts(rpc.read_landed(fx.spark, fx.land_receipts())))


@query
def src_rpc_logs(fx):
    return _text_topics(rpc.valid(rpc.logs(rpc.read_landed(fx.spark, fx.land_logs()))))


@query
def src_rpc_refused(fx):
    """Responses with a part that cannot be read: neither their other parts nor they themselves are lost from sight."""
    blocks = rpc.refused_blocks(rpc.read_landed(fx.spark, fx.land_blocks()))
    logs = rpc.refused_logs(rpc.read_landed(fx.spark, fx.land_logs()))
    return _union([
        df.select(F.lit(name).alias("source"), "chain_id", "status", "bad_parts", F.size(parts).cast("bigint").alias("n_parts"))
        for name, df, parts in (("blocks", blocks, "result.transactions"), ("logs", logs, "result"))
    ])


@query
def src_rpc_light_blocks(fx):
    return rpc.valid(rpc.light_blocks(rpc.read_landed(fx.spark, fx.land_light_blocks())))


@query
def src_rpc_heads(fx):
    return rpc.heads(rpc.read_landed(fx.spark, fx.land_heads()))


@query
def src_rpc_envelope(fx):
    landed = rpc.read_landed(fx.spark, fx.land_blocks())
    return rpc.envelope(landed, S.RPC_BLOCK, "hash").select(
        "chain_id", "status", "error", F.col("result.number").alias("number")
    )


@query
def src_topics(fx):
    messages = topics.read_files(fx.spark, fx.land_messages(), CHAINS, stream=False)
    return messages.select(
        "topic", "partition", "offset", F.unix_micros("timestamp").alias("micros"),
        F.col("value").cast("string").alias("value"),
    )


@query
def src_tables(fx):
    return _inventory(_tables(fx))


# --- sinks and table maintenance --------------------------------------------------------------


@query
def snk_encode_messages(fx):
    reorgs = R.reorg_messages(R.detect(fx.blocks, fx.canonical, _tips(fx)))
    published = I.publish(fx.blocks, fx.transactions, fx.receipts, fx.logs, PREFIX)
    return published.unionByName(M.encode_reorgs(reorgs, PREFIX))


@query
def snk_logs_append(fx):
    path = scratch_path(fx.spark, "logs")
    upper = fx.logs.withColumn("tx_hash", F.upper("tx_hash")).withColumn("address", F.upper("address"))
    tables.append(W.normalise_logs(upper), path, "log_index")
    tables.append(W.normalise_logs(fx.logs.where("removed")), path, "log_index")
    return _text_topics(tables.scan(fx.spark, path, S.LOGS))


def _stored_and_new(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    stored = W.first_writer(fx.deliveries.where("source = 'A'"), S.LOG_KEY)
    return stored, fx.deliveries.where("source <> 'A'")


@query
def snk_logs_insert_ignore(fx):
    stored, incoming = _stored_and_new(fx)
    return stored.unionByName(W.insert_ignore(stored, incoming, S.LOG_KEY))


@query
def snk_blocks_upsert(fx):
    return W.upsert_blocks(fx.block_versions)


@query
def snk_transactions_upsert(fx):
    return W.upsert_transactions(fx.transaction_versions)


@query
def snk_receipts_upsert(fx):
    return W.upsert_receipts(fx.receipt_versions, wide=True)


@query
def snk_balance_delta(fx):
    stored = B.partial_sums(B.credits(fx.logs, EVENT_A))
    return B.to_balances(B.add_deltas(stored, B.credits(fx.logs, EVENT_N)))


@query
def snk_reset_balances(fx):
    return B.reset(B.balances(fx.logs, EVENT_A), 2)


@query
def snk_delete_from(fx):
    return _inventory({n: W.delete_from(df, 2, 1200) for n, df in _tables(fx).items()})


def _block_updates(fx: Fixtures) -> DataFrame:
    return M.to_blocks(fx.changelog, "seq").select(
        "chain_id", F.col("block_number").alias("last_processed_block"), "seq"
    )


@query
def snk_state_set(fx):
    return W.set_state(_block_updates(fx)).select("chain_id", "last_processed_block")


@query
def snk_state_clear(fx):
    return W.clear_state(V.state(fx.changelog), [2])


@query
def tbl_evolve(fx):
    old = fx.blocks.where("chain_id = 1").drop("tx_count")
    new = W.evolve(fx.blocks.where("chain_id <> 1"), "tx_count", "bigint", 0)
    return W.union_evolved(old, new, {"tx_count": 0})


# --- projections and filters ---------------------------------------------------------------------


@query
def prj_decode_message(fx):
    return fx.decoded.select(
        "seq", "kind", "type", "chain_id", "block_number", "tx_hash", "log_index", "address", "data",
        "from_block", "dead_reason",
    )


@query
def prj_route(fx):
    return _union([df.select("kind", "chain_id", "seq") for df in M.route(fx.changelog).values()])


@query
def prj_to_log(fx):
    return _text_topics(M.to_logs(_as_messages(M.encode_logs(fx.logs, PREFIX))))


@query
def prj_to_block(fx):
    return M.to_blocks(_as_messages(M.encode_blocks(fx.blocks, PREFIX)))


@query
def prj_to_transaction(fx):
    return M.to_transactions(_as_messages(M.encode_transactions(fx.transactions, PREFIX)))


@query
def prj_to_receipt(fx):
    return M.to_receipts(_as_messages(M.encode_receipts(fx.receipts, PREFIX)))


@query
def flt_logs(fx):
    wanted = Q.LogFilter(
        chain_id=2, address=SUPPLIER.upper().replace("X", "x"), from_block=300, to_block=1800, bucket_width=BUCKET_WIDTH
    )
    return _text_topics(wanted.apply(fx.logs_by_bucket).select(*S.LOGS.fieldNames()))


@query
def flt_transactions(fx):
    wanted = Q.TransactionFilter(address=RECIPIENT, from_block=100, to_block=2000, bucket_width=BUCKET_WIDTH)
    return wanted.apply(fx.transactions_by_bucket).select(*S.TRANSACTIONS.fieldNames())


@query
def flt_balances(fx):
    return Q.BalanceFilter(chain_id=1).apply(B.balances(fx.logs, EVENT_A))


@query
def flt_logs_after(fx):
    page = Q.logs_after(fx.logs_by_bucket, 2, 1000, 500, bucket_width=BUCKET_WIDTH)
    return _text_topics(page.select(*S.LOGS.fieldNames()))


@query
def flt_block_hash(fx):
    wanted = fx.orders.select("chain_id", (F.col("block_number") + 1).alias("block_number"))
    return Q.block_hashes(fx.blocks, wanted)


@query
def flt_ingest(fx):
    return _text_topics(Q.ingest_filter(fx.logs, SUPPLIER, EVENT_A))


@query
def flt_event_id(fx):
    return _text_topics(fx.logs.where(event_matches("0x" + "AA" * 32)))


@query
def flt_dead_letter(fx):
    return M.dead_letters(fx.decoded).select("seq", "topic", "raw", "dead_stage", "dead_reason")


@query
def flt_chain_mismatch(fx):
    flagged = M.chain_mismatch(M.accepted(fx.changelog), PREFIX)
    return flagged.select("seq", "topic", "chain_id", "chain_mismatch")


# --- joins ---------------------------------------------------------------------------------------


@query
def jn_tx_receipt(fx):
    return C.with_receipts(fx.transactions, fx.receipts).drop("input")


@query
def jn_tx_missing_receipt(fx):
    return C.incomplete_blocks(fx.transactions, fx.receipts)


@query
def jn_reorg_compare(fx):
    return R.compare_hashes(fx.blocks, fx.canonical)


@query
def jn_insert_ignore(fx):
    stored, incoming = _stored_and_new(fx)
    return W.insert_ignore(stored, incoming, S.LOG_KEY)


@query
def jn_reorg_invalidate(fx):
    rows = M.accepted(fx.changelog).where(F.col("kind") != S.REORG)
    alive = R.invalidate(rows.select("chain_id", "block_number", "seq", "kind"), R.markers(fx.changelog))
    return alive.select("chain_id", "block_number", "seq", "kind")


@query
def jn_state_chains(fx):
    return P.state(V.state(fx.changelog), P.chains(fx.spark, [*CHAINS, 4]))


@query
def jn_block_range_state(fx):
    return P.blocks(fx.blocks, V.state(fx.changelog), 2)


# --- aggregations --------------------------------------------------------------------------------


@query
def agg_balances(fx):
    return B.balances(fx.logs, EVENT_A)


@query
def agg_balances_rebuild(fx):
    return B.rebuild(B.balances(fx.logs, EVENT_N), fx.logs, EVENT_A, 2)


@query
def agg_tx_summary(fx):
    return A.transaction_summary(fx.logs)


@query
def agg_block_range(fx):
    return A.block_range(fx.blocks)


@query
def agg_batch_max_block(fx):
    return A.batch_max_block(M.accepted(fx.changelog))


@query
def agg_offset_range(fx):
    return A.offset_range(M.accepted(fx.changelog))


@query
def agg_batch_counts(fx):
    return A.batch_counts(M.accepted(fx.changelog))


@query
def agg_tx_count(fx):
    return A.transactions_per_block(fx.transactions)


@query
def agg_last_processed(fx):
    return A.last_processed(V.state(fx.changelog), CHAINS)


@query
def agg_topic_messages(fx):
    return K.topic_messages(fx.changelog)


@query
def agg_partition_max_lag(fx):
    return K.max_lag(fx.changelog, X.processed_at())


@query
def agg_last_message(fx):
    return K.last_message(fx.changelog).select(
        "topic", "partition", "offset", "bytes", F.unix_micros("message_time").alias("micros")
    )


@query
def agg_errors(fx):
    return K.errors(M.dead_letters(fx.changelog))


@query
def agg_block_lag(fx):
    return K.block_lag(fx.heads, V.state(fx.changelog))


# --- writers by order, fork point -----------------------------------------------------------------


@query
def win_last_writer(fx):
    return W.last_writer(fx.transaction_versions, S.TX_KEY)


@query
def win_first_writer(fx):
    return W.first_writer(fx.deliveries, S.LOG_KEY)


def _tips(fx: Fixtures) -> DataFrame:
    return fx.heads.withColumnRenamed("latest_block", "last_processed_block")


@query
def win_fork_point(fx):
    forks = R.fork_points(R.compare_hashes(fx.blocks, fx.canonical), _tips(fx))
    return forks.select("chain_id", "tip", "fork_block")


@query
def win_parent_link(fx):
    return N.parent_links(fx.blocks, width=BUCKET_WIDTH)


@query
def win_cumulative_gas_check(fx):
    return N.cumulative_gas(fx.receipts, width=2)


# --- sorts, limits, gaps ----------------------------------------------------------------------------


@query
def srt_logs_ingest(fx):
    return _text_topics(tables.sort_for_ingest(fx.logs, "log_index"))


@query
def top_logs(fx):
    return _text_topics(Q.top_logs(fx.logs, 1000))


@query
def top_transactions(fx):
    return Q.top_transactions(fx.transactions, 1000)


@query
def top_balances(fx):
    return Q.top_balances(B.balances(fx.logs, EVENT_A), 1000)


@query
def top_tx_summary(fx):
    return A.top_transaction_summary(fx.logs, Q.LogFilter(from_block=50, limit=1001))


@query
def rng_coverage_gaps(fx):
    planned = fx.heads.selectExpr("chain_id", "0L as from_block", "latest_block + 10 as to_block")
    return C.coverage_gaps(planned, fx.blocks)


# --- set operations --------------------------------------------------------------------------------


@query
def set_merge_chunks(fx):
    block: Column = F.col("block_number")
    chunks = [fx.logs.where(block < 800), fx.logs.where(block.between(800, 1599)), fx.logs.where(block >= 1600)]
    return _text_topics(C.merge_chunks(chunks))


@query
def set_union_chains(fx):
    raw = fx.raw_messages
    per_chain = [raw.where(F.col("topic") == topics.topic_name(c, PREFIX)) for c in CHAINS]
    return topics.union_chains(per_chain).select("seq", "topic", "partition", "offset")


# --- streaming -----------------------------------------------------------------------------------------


@query
def st_confirmed_ingest(fx):
    state = fx.heads.where("chain_id <> 1").selectExpr("chain_id", "latest_block - 100 as last_processed_block")
    ranges = I.next_ranges(fx.heads, state, start_block=5, confirmations=12, batch_size=500)
    return I.in_ranges(fx.blocks, ranges).select("chain_id", "block_number", "block_hash")


def _stream(fx: Fixtures, after_batch=None) -> str:
    """Run recorded messages through the changelog job; the folder it wrote."""
    path = scratch_path(fx.spark, "changelog")
    source = topics.read_files(fx.spark, fx.land_messages(), CHAINS, max_files_per_trigger=fx.files_per_batch)
    order = F.expr("offset * 4 + partition")
    jobs.start_changelog(
        source, path, scratch_path(fx.spark, "offsets"), order,
        (lambda spark, batch_id: after_batch(spark, path, batch_id)) if after_batch else None,
    ).awaitTermination()
    return path


@query
def st_apply_batch(fx):
    stored = jobs.read_changelog(fx.spark, _stream(fx))
    return stored.select("seq", "kind", "chain_id", "block_number", "dead_reason")


@query
def st_reorg_barrier(fx):
    return _text_topics(V.logs(fx.changelog))


@query
def st_reorg_detect(fx):
    return R.detect(fx.blocks, fx.canonical, _tips(fx))


def _node_and_tips(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    node = rpc.valid(rpc.light_blocks(rpc.read_landed(fx.spark, fx.land_light_blocks())))
    ahead = _tips(fx).selectExpr("chain_id + 3 as chain_id", "last_processed_block")  # a chain without stored blocks
    return node, _tips(fx).unionByName(ahead.where("chain_id = 4"))


@query
def st_reorg_detect_node(fx):
    node, tips = _node_and_tips(fx)
    return R.detect(fx.blocks, node, tips)


@query
def st_reorg_detect_tip(fx):
    """The same decisions from the tip down, over block folders."""
    node, tips = _node_and_tips(fx)
    return reorg_search.detect_from_tip(reorg_search.reader(fx.blocks_by_bucket, BUCKET_WIDTH), reorg_search.reader(node), tips)


@query
def st_watermark(fx):
    return V.state(fx.changelog)


@query
def st_balance_incremental(fx):
    sums = scratch_path(fx.spark, "sums")

    def refresh(spark: SparkSession, path: str, batch_id: int) -> None:
        jobs.refresh_balances(spark, path, batch_id, sums, EVENT_A)

    _stream(fx, refresh)
    return jobs.incremental_balances(fx.spark, sums)


@query
def st_dedupe(fx):
    return fx.deliveries.dropDuplicates(S.LOG_KEY).select(*S.LOG_KEY)


#: source of the deliveries in a wave, hours of its event time: repeats, late rows, and repeats after their state expired
WAVES = (("A", 0), ("N", 1), ("R", 10), ("R", 2), ("A", 11))


@query
def st_dedupe_stream(fx):
    """Logs that the stream operator lets through, wave by wave over one checkpoint."""
    source, out, offsets = (scratch_path(fx.spark, name) for name in ("waves", "deduped", "offsets"))
    keys = fx.deliveries.select("source", *S.LOG_KEY)
    expected = fx.deliveries.count()  # from the footers
    shape = keys.withColumn("message_time", X.processed_at()).schema
    for name, hours in WAVES:
        wave = keys.where(F.col("source") == name)
        wave.withColumn("message_time", X.processed_at() + F.make_dt_interval(hours=F.lit(hours))).write.mode("append").parquet(source)
        rows = fx.spark.readStream.schema(shape).parquet(source)
        job = jobs.dedupe_stream(rows, "90 minutes").writeStream.format("parquet").option("checkpointLocation", offsets)
        with jobs.large_state(fx.spark, expected):
            job.trigger(availableNow=True).start(out).awaitTermination()
    return fx.spark.read.schema(shape).parquet(out).select(*S.LOG_KEY)


@query
def st_replay(fx):
    again = V.replayed(fx.changelog, 2, 300)
    return V.blocks(fx.changelog.unionByName(again))


@query
def st_confirmed_publish(fx):
    """Blocks as they come back from what two runs of the ordering job wrote."""

    def run(out: str) -> None:
        root = scratch_path(fx.spark, "ordering")
        for chain_id, latest in fx.heads.where("chain_id <> 1").collect():
            publish.rewind(fx.spark, root, chain_id, latest - 99)
        for _ in range(2):
            publish.run(
                fx.spark, root, publish.file_sink(out), fx.heads, _tables(fx), PREFIX, start_block=5, confirmations=12, batch_size=300, whole=False
            )

    sent = fx.spark.read.parquet(fx._landed("published", run))
    return M.to_blocks(_as_messages(sent)).select("chain_id", "block_number", "block_hash", "tx_count")


#: blocks in a bucket of the stored tables at least, so that few blocks fill several
STORED_WIDTH = 200


def _stored_width(fx: Fixtures) -> int:
    return tables.fitting_width(fx.message_height, STORED_WIDTH)


def _stored(fx: Fixtures) -> str:
    """Tables that the changelog job kept up to date batch by batch, folding as it went, and then replayed from a block."""

    def run(root: str) -> None:
        path, width = scratch_path(fx.spark, "changelog"), _stored_width(fx)

        def after(spark: SparkSession, batch_id: int) -> None:
            jobs.fold_changelog(spark, path, batch_id, fan=2)
            entities.refresh(spark, path, batch_id, root, width)

        source = topics.read_files(fx.spark, fx.land_messages(), CHAINS, max_files_per_trigger=fx.files_per_batch)
        order = F.expr("offset * 4 + partition")
        jobs.start_changelog(source, path, scratch_path(fx.spark, "offsets"), order, after, width=width).awaitTermination()
        entities.rebuild(fx.spark, path, root, 2, 300, width)

    return fx._landed("stored-tables", run)


@query
def st_stored_logs(fx):
    return _text_topics(entities.read(fx.spark, _stored(fx), "logs").drop("block_bucket"))


@query
def st_stored_blocks(fx):
    return entities.read(fx.spark, _stored(fx), "blocks").drop("block_bucket")


@query
def st_stored_transactions(fx):
    return entities.read(fx.spark, _stored(fx), "transactions").drop("block_bucket")


@query
def st_stored_receipts(fx):
    return entities.read(fx.spark, _stored(fx), "receipts").drop("block_bucket")


@query
def q_logs_stored(fx):
    wanted = Q.LogFilter(chain_id=2, from_block=100, limit=500)
    table = entities.read(fx.spark, _stored(fx), "logs", chain_id=2, from_block=100, width=_stored_width(fx))
    return _text_topics(P.logs(table, wanted))


@query
def q_transactions_stored(fx):
    wanted = Q.TransactionFilter(address="0x" + "5".rjust(40, "0"), limit=1000)
    table = entities.read(fx.spark, _stored(fx), "transactions", holding=wanted.address, fields=("from_addr", "to_addr"))
    return P.transactions(table, wanted)


# --- query endpoints --------------------------------------------------------------------------------------


@query
def q_logs(fx):
    wanted = Q.LogFilter(chain_id=1, from_block=100, limit=500, bucket_width=BUCKET_WIDTH)
    return _text_topics(P.logs(fx.logs_by_bucket, wanted))


@query
def q_transactions(fx):
    return P.transactions(fx.transactions, Q.TransactionFilter(address=RECIPIENT, limit=0))


@query
def q_balances(fx):
    return P.balances(B.balances(fx.logs, EVENT_A), Q.BalanceFilter(chain_id=3, limit=1000))


@query
def q_state(fx):
    return P.state(V.state(fx.changelog), P.chains(fx.spark, [*CHAINS, 31337]))


@query
def q_blocks(fx):
    return P.blocks(fx.blocks, V.state(fx.changelog))


@query
def q_reindex(fx):
    return P.reindex(V.state(fx.changelog), 2, 500)


@query
def q_metrics(fx):
    return P.metrics(fx.changelog, V.state(fx.changelog), fx.heads, X.processed_at(), X.started_at())
