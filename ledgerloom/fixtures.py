"""The driver's tables read as chain data.

``orders`` are transactions, ``lineitem`` rows their logs, order dates are blocks, and
``events`` are messages of a topic. Every view is a projection, a join on the order key
or a group-by; no window spans more than the lines of one order, so the views grow with
the tables.

Views are landed as Parquet in the shared folder, once per application and only when
asked for, in the layout the engine uses: operators then meet real tables with file
statistics and partitions, as they do in use.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas as S
from ledgerloom.operators import messages as M
from ledgerloom.session import DEFAULTS, scratch_path
from ledgerloom.sources import tables
from ledgerloom.streaming import jobs

_LANDED: dict[tuple[str, str, str], str] = {}

#: blocks in a bucket of the landed chain tables, so that their few thousand blocks fill several
BUCKET_WIDTH = 500
#: landed node responses: codec, and lines in a file at most
LANDED_CODEC = "gzip"
LINES_PER_FILE = 20_000
#: recorded messages: micro-batches they are read in, and about how many a file holds at most
STREAM_BATCHES = 3
MESSAGES_PER_FILE = 50_000

EVENT_A = "0x" + "aa" * 32
EVENT_N = "0x" + "bb" * 32
CHAINS = [1, 2, 3]

_ORDER = {
    "chain_id": "cast(1 + o_orderkey % 3 as bigint)",
    "block_number": "cast(datediff(cast(o_orderdate as date), date'1995-01-01') as bigint)",
    "tx_hash": "concat('0x', lpad(lower(hex(o_orderkey)), 64, '0'))",
    "to_addr": "case when o_orderkey % 20 = 0 then null "
    "else concat('0x', lpad(lower(hex(1000000 + o_orderkey % 100)), 40, '0')) end",
}
_BLOCK_HASH = "concat('0x', sha2(concat('b', chain_id, ':', block_number), 256))"
_CENTS_HEX = (
    "lpad(concat(lower(hex(cast(round({of}l_extendedprice * 100) as bigint))), "
    "case when {of}l_linenumber = 2 then repeat('0', 20) else '' end), 64, '0')"
)
_TOPIC0 = (
    "concat('0x', repeat(case {of}l_returnflag when 'A' then 'aa' when 'N' then 'bb' else 'cc' end, 32))"
)
#: orders of which the first part of a node's response cannot be read
BAD_PART = "o_orderkey % 97 = 5"
_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _hex(number: str) -> str:
    return f"concat('0x', lower(hex({number})))"


def _placed(orders: DataFrame) -> DataFrame:
    """Rows that hold an order's key and date, with its place on a chain: numbers only."""
    return orders.selectExpr("*", *[f"{_ORDER[n]} as {n}" for n in ("chain_id", "block_number")], "o_orderkey div 3 as tx_index")


def _with_hashes(placed: DataFrame) -> DataFrame:
    """Hashes and addresses of placed rows. They follow from the numbers and are several times as wide, so rows are
    joined, spread and sorted before."""
    return placed.selectExpr("*", *[f"{_ORDER[n]} as {n}" for n in ("tx_hash", "to_addr")], f"{_BLOCK_HASH} as block_hash")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        # Message times are compared with UTC literals.
        spark.conf.set("spark.sql.session.timeZone", DEFAULTS["spark.sql.session.timeZone"])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with their chain coordinates."""
        return _with_hashes(_placed(self.table("orders")))

    def _transactions(self, placed: DataFrame) -> DataFrame:
        return _with_hashes(placed).selectExpr(
            "block_bucket", "chain_id", "tx_hash", "block_number", "block_hash", "tx_index",
            "concat('0x', lpad(lower(hex(o_custkey)), 40, '0')) as from_addr",
            "to_addr",
            "cast(cast(round(o_totalprice * 100) as decimal(38,0)) * 100000000000000 as string) as value",
            "cast(o_orderkey % 7 as bigint) as nonce",
            "cast(21000 + o_orderkey % 5000 as bigint) as gas",
            "cast(1000000000 + o_orderkey as string) as gas_price",
            "'0x' as input",
            "cast(case when o_orderpriority = '1-URGENT' then 2 else 0 end as bigint) as tx_type",
        )

    def _receipts(self, placed: DataFrame) -> DataFrame:
        return _with_hashes(placed).selectExpr(
            "block_bucket", "chain_id", "tx_hash", "block_number", "block_hash", "tx_index",
            "cast(case when o_orderstatus = 'F' then 0 else 1 end as bigint) as status",
            "cast((1 + o_orderkey % 100) * 22000 as bigint) as cumulative_gas_used",
            "cast(21000 + o_orderkey % 1000 as bigint) as gas_used",
            "case when to_addr is null then concat('0x', lpad(lower(hex(2000000 + o_orderkey)), 40, '0')) end"
            " as contract_address",
            "concat('0x', repeat('0', 512)) as logs_bloom",
            "cast(1000000000 + o_orderkey as string) as effective_gas_price",
        )

    def _blocks(self) -> DataFrame:
        return (
            self.orders.groupBy("chain_id", "block_number", "block_hash")
            .agg(
                F.sum(F.expr("21000 + o_orderkey % 5000")).cast("bigint").alias("gas_used"),
                F.count("*").alias("tx_count"),
            )
            .selectExpr(
                "chain_id", "block_number", "block_hash",
                "concat('0x', sha2(concat('b', chain_id, ':', block_number - 1), 256)) as parent_hash",
                "788918400 + block_number * 86400 as timestamp",
                "cast(30000000 as bigint) as gas_limit", "gas_used", "tx_count",
            )
        )

    @cached_property
    def placed_lines(self) -> DataFrame:
        """Line items with chain, block and position in their order, from 1; no hash is made before the join."""
        order = self.table("orders").select("o_orderkey", "o_orderdate")
        joined = self.table("lineitem").join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        position = f"row_number() over (partition by l_orderkey order by {_LINE_ORDER})"
        return _placed(joined.selectExpr("*", f"cast({position} as bigint) as seq"))

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with the hashes of their order as well."""
        return _with_hashes(self.placed_lines)

    def _logs(self, placed: DataFrame) -> DataFrame:
        return _with_hashes(placed).selectExpr(
            "block_bucket", "chain_id", "block_number", "block_hash", "tx_hash", "log_index",
            "concat('0x', lpad(lower(hex(l_suppkey)), 40, '0')) as address",
            f"concat('0x', {_CENTS_HEX.format(of='')}) as data",
            f"case when l_linenumber = 7 then array({_TOPIC0.format(of='')}) "
            f"else array({_TOPIC0.format(of='')}, concat('0x', lpad(lower(hex(l_partkey)), 64, '0'))) end as topics",
            "l_linestatus = 'F' and l_linenumber = 3 as removed",
        )

    def _deliveries(self) -> DataFrame:
        """At-least-once log deliveries: the line number repeats within an order."""
        return self.lines.selectExpr(
            "chain_id", "block_number", "block_hash", "tx_hash",
            "cast(l_linenumber as bigint) as log_index",
            "concat('0x', lpad(lower(hex(l_suppkey)), 40, '0')) as address",
            "seq", "l_returnflag as source",
        )

    def _transaction_versions(self) -> DataFrame:
        """Several unnormalised deliveries per transaction, moving between blocks."""
        return self.lines.selectExpr(
            "chain_id", "concat('0x', upper(substring(tx_hash, 3))) as tx_hash",
            "block_number + l_linenumber as block_number", "upper(block_hash) as block_hash",
            "cast(l_linenumber as bigint) as tx_index",
            "concat('0x', lpad(hex(l_suppkey), 40, '0')) as from_addr",
            "case when l_linenumber = 7 then '' else concat('0x', lpad(hex(l_partkey), 40, '0')) end as to_addr",
            "case when l_tax = 0 then '' else cast(cast(round(l_extendedprice * 100) as bigint) as string) end"
            " as value",
            "seq as nonce", "cast(21000 + l_partkey as bigint) as gas",
            "case when l_discount = 0 then '' else cast(l_partkey as string) end as gas_price",
            "'0x' as input", "cast(0 as bigint) as tx_type", "seq",
        )

    def _receipt_versions(self) -> DataFrame:
        return self.lines.selectExpr(
            "chain_id", "concat('0x', upper(substring(tx_hash, 3))) as tx_hash",
            "block_number + l_linenumber as block_number", "upper(block_hash) as block_hash",
            "cast(l_linenumber as bigint) as tx_index",
            "cast(case when l_linestatus = 'F' then 0 else 1 end as bigint) as status",
            "cast(l_partkey * 10 as bigint) as cumulative_gas_used",
            "cast(21000 + l_partkey as bigint) as gas_used",
            "case when l_linenumber = 7 then concat('0x', lpad(hex(l_suppkey), 40, '0')) else '' end"
            " as contract_address",
            "concat('0x', repeat('0', 512)) as logs_bloom",
            "case when l_discount = 0 then '' else cast(l_partkey as string) end as effective_gas_price", "seq",
        )

    def _block_versions(self) -> DataFrame:
        """One version of a block per order in it; the highest order key came last."""
        return self.orders.selectExpr(
            "chain_id", "block_number", "concat(block_hash, ':', o_orderkey) as block_hash",
            "concat('0x', sha2(concat('b', chain_id, ':', block_number - 1), 256)) as parent_hash",
            "788918400 + block_number * 86400 as timestamp", "cast(30000000 as bigint) as gas_limit",
            "cast(21000 + o_orderkey % 5000 as bigint) as gas_used", "cast(o_custkey as bigint) as tx_count",
            "o_orderkey as seq",
        )

    @cached_property
    def canonical(self) -> DataFrame:
        """The node's hashes: upper case where equal, different from a block on."""
        return self.blocks.selectExpr(
            "chain_id", "block_number",
            "case when block_number >= 2300 + 10 * chain_id then concat('0x', sha2(block_hash, 256)) "
            "else upper(block_hash) end as block_hash",
        )

    @cached_property
    def heads(self) -> DataFrame:
        return self.blocks.groupBy("chain_id").agg(F.max("block_number").alias("latest_block"))

    # --- messages -------------------------------------------------------------------------

    def _raw_messages(self, files: int | None = None) -> DataFrame:
        """Kafka-shaped rows with ``seq``, spread by arrival. Error events carry each kind of broken message.

        Events are spread before their messages are made: these are wider, and the spreading reads its input twice.
        """
        bounds = [files] if files else []
        base = self.table("events").repartitionByRange(*bounds, "event_id").selectExpr(
            "event_id as seq", "cast(1 + user_id % 3 as bigint) as chain_id", "user_id", "value as amount",
            "cast(event_id % 4 as int) as partition", "event_id div 4 as offset",
            "cast(ts as timestamp) as timestamp", "event_id div 10 as block_number",
            "case when event_id % 1000 = 999 then 'reorg' when event_type = 'click' then 'log' "
            "when event_type = 'view' then 'block' when event_type = 'purchase' then 'transaction' "
            "when event_type = 'signup' then 'receipt' else '' end as type",
            "cast(round(value * 100) as bigint) as cents",
        ).selectExpr("*", f"{_BLOCK_HASH} as block_hash")
        user = "concat('0x', lpad(lower(hex(user_id)), {}, '0'))"

        def on(kinds: str, expr: str, name: str) -> str:
            return f"case when type in ({kinds}) then {expr} end as `{name}`"

        body = base.selectExpr(
            "seq", "partition", "offset", "timestamp", "type", "chain_id", "amount",
            "to_json(struct(" + ", ".join([
                "type", "chain_id",
                on("'log', 'block', 'transaction', 'receipt'", "nullif(block_number, 0)", "block_number"),
                on("'log', 'block', 'transaction', 'receipt'", "block_hash", "block_hash"),
                on("'block'", "concat('0x', sha2(concat('b', chain_id, ':', block_number - 1), 256))", "parent_hash"),
                on("'block'", "1704067200 + block_number", "timestamp"),
                on("'block'", "30000000", "block_gas_limit"),
                on("'block'", "nullif(cents, 0)", "block_gas_used"),
                on("'block'", "nullif(seq % 10, 0)", "tx_count"),
                f"case when type = 'log' then concat('0x', lpad(lower(hex(chain_id)), 64, '0')) "
                f"when type in ('transaction', 'receipt') then {user.format(64)} end as tx_hash",
                on("'log'", "nullif(seq % 2, 0)", "log_index"),
                on("'log'", user.format(40), "address"),
                on("'log'", "concat('0x', lpad(lower(hex(cents)), 64, '0'))", "data"),
                on("'log'", f"array('{EVENT_A}', {user.format(64)})", "topics"),
                on("'transaction', 'receipt'", "nullif(seq % 10, 0)", "tx_index"),
                on("'transaction'", user.format(40), "from"),
                on("'transaction'", "cast(cents as string)", "value"),
                on("'transaction'", "nullif(seq % 7, 0)", "nonce"),
                on("'transaction'", "21000", "gas"),
                on("'receipt'", "nullif(seq % 2, 0)", "status"),
                on("'receipt'", "21000", "receipt_gas_used"),
                on("'receipt'", "cast(cents as string)", "effective_gas_price"),
                on("'reorg'", "nullif(greatest(block_number - 5, 0), 0)", "from_block"),
                on("'reorg'", "'reorg'", "reason"),
            ]) + ")) as json",
        )
        broken = (
            "case when type <> '' then json "
            "when amount < 10 then '{\"type\":\"log\",\"chain_id\":' "
            "when amount < 20 then '{\"type\":\"log\",\"block_number\":7}' "
            "when amount < 30 then '{\"type\":\"block\",\"chain_id\":1,\"block_number\":\"7\"}' "
            "when amount < 40 then '{\"type\":\"uncle\",\"chain_id\":1,\"block_number\":7}' "
            "when amount < 50 then '{\"type\":\"block\",\"chain_id\":1,\"block_number\":18446744073709551615}' "
            "else '{\"chain_id\":1,\"block_number\":7}' end"
        )
        return body.selectExpr(
            "seq",
            "concat('chain-logs-', case when amount > 200 then 1 else chain_id end) as topic",
            "partition", "offset", "timestamp", "cast(null as binary) as key",
            f"cast({broken} as binary) as value",
        )

    # --- landed tables ------------------------------------------------------------------------

    def _landed(self, name: str, write: Callable[[str], None]) -> str:
        """Path of a view, written on first use."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _LANDED:
            path = scratch_path(self.spark, name)
            write(path)
            _LANDED[key] = path
        return _LANDED[key]

    def _by_bucket(
        self, name: str, rows: DataFrame, schema: T.StructType, position: str, finish: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        path = self._landed(name, lambda p: tables.append(rows, p, position, BUCKET_WIDTH, finish=finish))
        return tables.stored(self.spark, path, schema)

    def _plain_table(self, name: str, view: DataFrame) -> DataFrame:
        return self.spark.read.parquet(self._landed(name, lambda p: view.write.parquet(p)))

    @cached_property
    def logs_by_bucket(self) -> DataFrame:
        placed = self.placed_lines.withColumn("log_index", F.expr("(l_orderkey div 3) * 1024 + seq - 1"))
        return self._by_bucket("logs", placed, S.LOGS, "log_index", self._logs)

    @cached_property
    def transactions_by_bucket(self) -> DataFrame:
        return self._by_bucket("transactions", _placed(self.table("orders")), S.TRANSACTIONS, "tx_index", self._transactions)

    @cached_property
    def receipts_by_bucket(self) -> DataFrame:
        """Receipts; low-priority pending orders above a price have none."""
        lacking = "o_orderstatus = 'P' and o_orderpriority = '5-LOW' and o_totalprice > 400000"
        placed = _placed(self.table("orders").where(f"not ({lacking})"))
        return self._by_bucket("receipts", placed, S.RECEIPTS, "tx_index", self._receipts)

    @cached_property
    def blocks_by_bucket(self) -> DataFrame:
        return self._by_bucket("blocks", self._blocks(), S.BLOCKS, "block_hash")

    @cached_property
    def logs(self) -> DataFrame:
        return self.logs_by_bucket.select(*S.LOGS.fieldNames())

    @cached_property
    def blocks(self) -> DataFrame:
        return self.blocks_by_bucket.select(*S.BLOCKS.fieldNames())

    @cached_property
    def transactions(self) -> DataFrame:
        return self.transactions_by_bucket.select(*S.TRANSACTIONS.fieldNames())

    @cached_property
    def receipts(self) -> DataFrame:
        return self.receipts_by_bucket.select(*S.RECEIPTS.fieldNames())

    @cached_property
    def deliveries(self) -> DataFrame:
        return self._plain_table("deliveries", self._deliveries())

    @cached_property
    def transaction_versions(self) -> DataFrame:
        return self._plain_table("transaction-versions", self._transaction_versions())

    @cached_property
    def receipt_versions(self) -> DataFrame:
        return self._plain_table("receipt-versions", self._receipt_versions())

    @cached_property
    def block_versions(self) -> DataFrame:
        return self._plain_table("block-versions", self._block_versions())

    @cached_property
    def raw_messages(self) -> DataFrame:
        """Recorded messages, spread over files by arrival."""
        return self._plain_table("messages", self._raw_messages())

    @cached_property
    def decoded(self) -> DataFrame:
        """Changelog rows decoded on the fly."""
        return M.decode(self.raw_messages, "seq")

    @cached_property
    def changelog(self) -> DataFrame:
        """The stored changelog."""
        path = self._landed("changelog", lambda p: jobs.store_batch(self.decoded, 0, p))
        return jobs.read_changelog(self.spark, path)

    # --- landed node responses ---------------------------------------------------------------

    def _land(self, name: str, rows: DataFrame) -> str:
        """Compressed JSON lines. A compressed file is read by one task, so its lines are bounded."""
        writer = rows.select("chain_id", "value").write.partitionBy("chain_id")
        writer = writer.option("compression", LANDED_CODEC).option("maxRecordsPerFile", LINES_PER_FILE)
        return self._landed(name, writer.text)

    def _orders_with_lines(self, *fields: str) -> DataFrame:
        """Orders, each with an array of its lines in line order; bounded by the lines of an order.

        Bare columns are moved, once; hashes and hex text are made afterwards. Rows meet before they are collected:
        a collection within the input's tasks finds nothing to reduce and sorts all that they read.
        """
        lines = self.table("lineitem").repartition("l_orderkey").groupBy("l_orderkey").agg(
            F.sort_array(F.collect_list(F.expr(f"struct({', '.join([_LINE_ORDER, *fields])})"))).alias("lines")
        )
        joined = self.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return _with_hashes(_placed(joined))

    def land_blocks(self) -> str:
        """One block response per order, its lines as transactions; some fail, are not there or hold a bad nonce."""
        transaction = (
            "struct(concat('0x', lpad(hex(o_orderkey * 1024 + i), 64, '0')) as hash, "
            "block_hash as blockHash, "
            f"{_hex('o_orderkey')} as blockNumber, {_hex('i')} as transactionIndex, "
            "concat('0x', lpad(hex(l.l_suppkey), 40, '0')) as `from`, "
            "case when l.l_linenumber < 7 then concat('0x', lpad(hex(l.l_partkey), 40, '0')) end as `to`, "
            f"concat('0x', {_CENTS_HEX.format(of='l.')}) as value, "
            f"case when i = 0 and {BAD_PART} then '0xZZ' else {_hex('cast(l.l_linenumber as bigint)')} end as nonce, "
            f"{_hex('21000 + l.l_partkey')} as gas, "
            f"case when l.l_linenumber = 1 then '0x' else {_hex('l.l_partkey')} end as gasPrice, "
            "'0xAb' as input, case when l.l_linenumber = 2 then '' else '0x2' end as type)"
        )
        result = (
            f"struct(upper(block_hash) as hash, block_hash as parentHash, {_hex('o_orderkey')} as number, "
            f"{_hex('788918400 + block_number * 86400')} as timestamp, '0x1C9C380' as gasLimit, "
            f"{_hex('21000 + o_orderkey % 5000')} as gasUsed, "
            f"transform(coalesce(lines, array()), (l, i) -> {transaction}) as transactions)"
        )
        value = (
            "case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then "
            "'{\"jsonrpc\":\"2.0\",\"id\":1,\"error\":{\"code\":-32000,\"message\":\"busy\"}}' "
            "when o_orderstatus = 'P' and o_orderpriority = '2-HIGH' then "
            "'{\"jsonrpc\":\"2.0\",\"id\":1,\"result\":null}' "
            "when o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM' then '{\"jsonrpc\":\"2.0\",\"id\":1}' "
            f"else to_json(struct('2.0' as jsonrpc, 1 as id, {result} as result)) end"
        )
        return self._land("node-blocks", self._orders_with_lines().selectExpr("chain_id", f"{value} as value"))

    def land_light_blocks(self) -> str:
        """Hash-only responses for every block: chain 1 agrees, chain 2 differs from a block on, chain 3 lacks its tip."""
        result = (
            "struct(case when chain_id = 2 and block_number >= 2300 then concat('0x', sha2(block_hash, 256)) "
            f"else upper(block_hash) end as hash, parent_hash as parentHash, {_hex('block_number')} as number, "
            "array(block_hash) as transactions)"
        )
        value = (
            "case when chain_id = 3 and block_number >= 2300 then '{\"jsonrpc\":\"2.0\",\"id\":1,\"result\":null}' "
            f"else to_json(struct('2.0' as jsonrpc, 1 as id, {result} as result)) end"
        )
        return self._land("node-light-blocks", self.blocks.selectExpr("chain_id", f"{value} as value"))

    def land_heads(self) -> str:
        """One answer per stored block, as a poller would land them; every tenth failed."""
        value = (
            "case when block_number % 10 = 3 then "
            "'{\"jsonrpc\":\"2.0\",\"id\":1,\"error\":{\"code\":-32000,\"message\":\"busy\"}}' "
            f"else to_json(struct('2.0' as jsonrpc, 1 as id, {_hex('block_number + 2')} as result)) end"
        )
        return self._land("node-heads", self.blocks.selectExpr("chain_id", f"{value} as value"))

    def land_receipts(self) -> str:
        """One receipt response per order; pending orders leave numbers out."""
        result = (
            "struct(upper(tx_hash) as transactionHash, upper(block_hash) as blockHash, "
            f"{_hex('block_number')} as blockNumber, {_hex('tx_index')} as transactionIndex, "
            "case o_orderstatus when 'F' then '0x0' when 'O' then '0x1' end as status, "
            f"{_hex('(1 + o_orderkey % 100) * 22000')} as cumulativeGasUsed, "
            f"case when o_orderstatus = 'P' then '' else {_hex('21000 + o_orderkey % 1000')} end as gasUsed, "
            "case when to_addr is null then concat('0x', lpad(hex(2000000 + o_orderkey), 40, '0')) end"
            " as contractAddress, '0x00' as logsBloom, "
            f"{_hex('1000000000 + o_orderkey')} as effectiveGasPrice)"
        )
        value = f"to_json(struct('2.0' as jsonrpc, 1 as id, {result} as result))"
        return self._land("node-receipts", self.orders.selectExpr("chain_id", f"{value} as value"))

    def land_logs(self) -> str:
        """One log response per order: an array, empty for an order without lines; some hold a log without an index."""
        log = (
            "struct(concat('0x', lpad(hex(l.l_suppkey), 40, '0')) as address, "
            f"array({_TOPIC0.format(of='l.')}, concat('0x', lpad(hex(l.l_partkey), 64, '0'))) as topics, "
            f"concat('0x', {_CENTS_HEX.format(of='l.')}) as data, {_hex('block_number')} as blockNumber, "
            "upper(block_hash) as blockHash, tx_hash as transactionHash, "
            f"case when i = 0 and {BAD_PART} then '' else {_hex('tx_index * 1024 + i')} end as logIndex, "
            "l.l_linestatus = 'F' as removed)"
        )
        value = (
            "to_json(struct('2.0' as jsonrpc, 1 as id, "
            f"transform(coalesce(lines, array()), (l, i) -> {log}) as result))"
        )
        return self._land("node-logs", self._orders_with_lines("l_returnflag", "l_linestatus").selectExpr("chain_id", f"{value} as value"))

    def land_messages(self) -> str:
        """Recorded messages as topic files, each a range of arrivals: three at least, bounded in size."""
        rows = self._raw_messages(self.message_files).drop("seq")
        return self._landed("topic-files", lambda p: rows.write.parquet(p))

    @cached_property
    def message_files(self) -> int:
        """Files of messages; the count of rows comes from the footers."""
        return max(STREAM_BATCHES, -(-self.table("events").count() // MESSAGES_PER_FILE))

    @cached_property
    def message_height(self) -> int:
        """The highest block that messages are of, one number."""
        return self.table("events").agg(F.expr("coalesce(max(event_id), 0) div 10")).first()[0]

    @property
    def files_per_batch(self) -> int:
        """Files that a micro-batch takes so that the messages come in three, whatever their number."""
        return -(-self.message_files // STREAM_BATCHES)


def processed_at() -> Column:
    """The processing time lags are measured against."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def started_at() -> Column:
    return F.lit("2024-01-31 23:00:00").cast("timestamp")
