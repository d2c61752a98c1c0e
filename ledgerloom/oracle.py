"""The same results as plain SQL, for DuckDB over the driver's tables."""

from __future__ import annotations

from ledgerloom.catalog import RECIPIENT, SUPPLIER

ORACLE: dict[str, str] = {}

_A, _N = "0x" + "aa" * 32, "0x" + "bb" * 32


def _word(number: str, digits: int = 64) -> str:
    return f"'0x' || lpad(lower(hex({number})), {digits}, '0')"


def _upper_word(number: str, digits: int = 64) -> str:
    return f"'0x' || lpad(hex({number}), {digits}, '0')"


def _json(fields: list[tuple[str, str, str]]) -> str:
    """JSON text of (name, kind, expression); zero and NULL values are left out."""
    parts = []
    for name, kind, expr in fields:
        if kind == "uint":
            part = f"case when coalesce({expr}, 0) <> 0 then ',\"{name}\":' || ({expr}) else '' end"
        elif kind == "text":
            part = f"case when coalesce({expr}, '') <> '' then ',\"{name}\":\"' || ({expr}) || '\"' else '' end"
        elif kind == "bool":
            part = f"case when {expr} then ',\"{name}\":true' else '' end"
        else:
            part = (
                f"case when len({expr}) > 0 then ',\"{name}\":[\"' || array_to_string({expr}, '\",\"') || '\"]' else '' end"
            )
        parts.append(part)
    return "'{' || substring(" + " || ".join(parts) + ", 2) || '}'"


_CENTS_HEX = (
    "lpad(lower(hex(cast(round(l_extendedprice * 100) as bigint))) || "
    "case when l_linenumber = 2 then repeat('0', 20) else '' end, 64, '0')"
)
_AMOUNT = (
    "cast(round(l_extendedprice * 100) as hugeint) * "
    "case when l_linenumber = 2 then 1208925819614629174706176::hugeint else 1::hugeint end"
)
_TOPIC0 = "'0x' || repeat(case l_returnflag when 'A' then 'aa' when 'N' then 'bb' else 'cc' end, 32)"
_BLOCK_HASH = "'0x' || sha256('b' || chain_id || ':' || block_number)"
_PARENT_HASH = "'0x' || sha256('b' || chain_id || ':' || (block_number - 1))"

_CTES = {
    "o": f"""
select *, {_BLOCK_HASH} as block_hash, o_orderkey // 3 as tx_index from (
  select *, cast(1 + o_orderkey % 3 as bigint) as chain_id,
    cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as bigint) as block_number,
    {_word('o_orderkey')} as tx_hash,
    case when o_orderkey % 20 = 0 then null else {_word('1000000 + o_orderkey % 100', 40)} end as to_addr
  from orders)""",
    "tx": f"""
select chain_id, tx_hash, block_number, block_hash, tx_index, {_word('o_custkey', 40)} as from_addr, to_addr,
  cast(cast(round(o_totalprice * 100) as hugeint) * 100000000000000 as varchar) as value,
  cast(o_orderkey % 7 as bigint) as nonce, cast(21000 + o_orderkey % 5000 as bigint) as gas,
  cast(1000000000 + o_orderkey as varchar) as gas_price, '0x' as input,
  cast(case when o_orderpriority = '1-URGENT' then 2 else 0 end as bigint) as tx_type from o""",
    "rc": f"""
select chain_id, tx_hash, block_number, block_hash, tx_index,
  cast(case when o_orderstatus = 'F' then 0 else 1 end as bigint) as status,
  cast((1 + o_orderkey % 100) * 22000 as bigint) as cumulative_gas_used,
  cast(21000 + o_orderkey % 1000 as bigint) as gas_used,
  case when to_addr is null then {_word('2000000 + o_orderkey', 40)} end as contract_address,
  '0x' || repeat('0', 512) as logs_bloom, cast(1000000000 + o_orderkey as varchar) as effective_gas_price
from o where not (o_orderstatus = 'P' and o_orderpriority = '5-LOW' and o_totalprice > 400000)""",
    "bl": f"""
select chain_id, block_number, block_hash, {_PARENT_HASH} as parent_hash,
  cast(788918400 + block_number * 86400 as bigint) as timestamp, cast(30000000 as bigint) as gas_limit,
  cast(sum(21000 + o_orderkey % 5000) as bigint) as gas_used, count(*) as tx_count
from o group by chain_id, block_number, block_hash""",
    "ln": """
select l.*, o.o_orderkey, o.chain_id, o.block_number, o.block_hash, o.tx_hash,
  cast(row_number() over (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as seq
from lineitem l join o on l_orderkey = o_orderkey""",
    "lg": f"""
select chain_id, block_number, block_hash, tx_hash, (l_orderkey // 3) * 1024 + seq - 1 as log_index,
  {_word('l_suppkey', 40)} as address, '0x' || {_CENTS_HEX} as data,
  case when l_linenumber = 7 then list_value({_TOPIC0})
    else list_value({_TOPIC0}, {_word('l_partkey')}) end as topics,
  (l_linestatus = 'F' and l_linenumber = 3) as removed, {_AMOUNT} as amount,
  case when l_linenumber <> 7 then {_word('l_partkey', 40)} end as credit from ln""",
    "lgt": """
select chain_id, block_number, block_hash, tx_hash, log_index, address, data,
  array_to_string(topics, ',') as topics, removed, topics[1] as topic0 from lg""",
    "dl": f"""
select chain_id, block_number, block_hash, tx_hash, cast(l_linenumber as bigint) as log_index,
  {_word('l_suppkey', 40)} as address, seq, l_returnflag as source from ln""",
    "txv": f"""
select chain_id, '0x' || upper(substring(tx_hash, 3)) as tx_hash, block_number + l_linenumber as block_number,
  upper(block_hash) as block_hash, cast(l_linenumber as bigint) as tx_index,
  {_upper_word('l_suppkey', 40)} as from_addr,
  case when l_linenumber = 7 then '' else {_upper_word('l_partkey', 40)} end as to_addr,
  case when l_tax = 0 then '' else cast(cast(round(l_extendedprice * 100) as bigint) as varchar) end as value,
  seq as nonce, cast(21000 + l_partkey as bigint) as gas,
  case when l_discount = 0 then '' else cast(l_partkey as varchar) end as gas_price,
  '0x' as input, cast(0 as bigint) as tx_type, seq from ln""",
    "rcv": f"""
select chain_id, '0x' || upper(substring(tx_hash, 3)) as tx_hash, block_number + l_linenumber as block_number,
  upper(block_hash) as block_hash, cast(l_linenumber as bigint) as tx_index,
  cast(case when l_linestatus = 'F' then 0 else 1 end as bigint) as status,
  cast(l_partkey * 10 as bigint) as cumulative_gas_used, cast(21000 + l_partkey as bigint) as gas_used,
  case when l_linenumber = 7 then {_upper_word('l_suppkey', 40)} else '' end as contract_address,
  '0x' || repeat('0', 512) as logs_bloom,
  case when l_discount = 0 then '' else cast(l_partkey as varchar) end as effective_gas_price, seq from ln""",
    "blv": f"""
select chain_id, block_number, block_hash || ':' || o_orderkey as block_hash, {_PARENT_HASH} as parent_hash,
  cast(788918400 + block_number * 86400 as bigint) as timestamp, cast(30000000 as bigint) as gas_limit,
  cast(21000 + o_orderkey % 5000 as bigint) as gas_used, cast(o_custkey as bigint) as tx_count,
  o_orderkey as seq from o""",
    "cn": """
select chain_id, block_number, case when block_number >= 2300 + 10 * chain_id then '0x' || sha256(block_hash)
  else upper(block_hash) end as block_hash from bl""",
    "hd": "select chain_id, max(block_number) as latest_block from bl group by chain_id",
    "cmp": """
select b.chain_id, b.block_number, b.block_hash, c.block_hash as node_hash,
  lower(b.block_hash) = lower(c.block_hash) as same from bl b left join cn c using (chain_id, block_number)""",
    "bal": f"""
select chain_id, credit as address, topics[1] as topic0, sum(amount) as balance from lg
where credit is not null and amount <> 0 and topics[1] in ('{_A}', '{_N}') group by all""",
    "ev": f"""
select *, {_BLOCK_HASH} as block_hash, {_PARENT_HASH} as parent_hash from (
  select event_id as seq, cast(1 + user_id % 3 as bigint) as chain_id, user_id, value as amount,
    cast(event_id % 4 as integer) as partition, event_id // 4 as "offset", epoch_us(ts) as micros,
    event_id // 10 as block_number, cast(round(value * 100) as bigint) as cents,
    case when event_id % 1000 = 999 then 'reorg' when event_type = 'click' then 'log'
      when event_type = 'view' then 'block' when event_type = 'purchase' then 'transaction'
      when event_type = 'signup' then 'receipt' else '' end as type from events)""",
    "raw": f"""
select *, 'chain-logs-' || case when amount > 200 then 1 else chain_id end as topic,
  case type
  when 'log' then {_json([
      ('type', 'text', 'type'), ('chain_id', 'uint', 'chain_id'), ('block_number', 'uint', 'block_number'),
      ('block_hash', 'text', 'block_hash'), ('tx_hash', 'text', _word('chain_id')), ('log_index', 'uint', 'seq % 2'),
      ('address', 'text', _word('user_id', 40)), ('data', 'text', _word('cents')),
      ('topics', 'list', f"list_value('{_A}', {_word('user_id')})")])}
  when 'block' then {_json([
      ('type', 'text', 'type'), ('chain_id', 'uint', 'chain_id'), ('block_number', 'uint', 'block_number'),
      ('block_hash', 'text', 'block_hash'), ('parent_hash', 'text', 'parent_hash'),
      ('timestamp', 'uint', '1704067200 + block_number'), ('block_gas_limit', 'uint', '30000000'),
      ('block_gas_used', 'uint', 'cents'), ('tx_count', 'uint', 'seq % 10')])}
  when 'transaction' then {_json([
      ('type', 'text', 'type'), ('chain_id', 'uint', 'chain_id'), ('block_number', 'uint', 'block_number'),
      ('block_hash', 'text', 'block_hash'), ('tx_hash', 'text', _word('user_id')), ('tx_index', 'uint', 'seq % 10'),
      ('from', 'text', _word('user_id', 40)), ('value', 'text', 'cast(cents as varchar)'),
      ('nonce', 'uint', 'seq % 7'), ('gas', 'uint', '21000')])}
  when 'receipt' then {_json([
      ('type', 'text', 'type'), ('chain_id', 'uint', 'chain_id'), ('block_number', 'uint', 'block_number'),
      ('block_hash', 'text', 'block_hash'), ('tx_hash', 'text', _word('user_id')), ('tx_index', 'uint', 'seq % 10'),
      ('status', 'uint', 'seq % 2'), ('receipt_gas_used', 'uint', '21000'),
      ('effective_gas_price', 'text', 'cast(cents as varchar)')])}
  when 'reorg' then {_json([
      ('type', 'text', 'type'), ('chain_id', 'uint', 'chain_id'),
      ('from_block', 'uint', 'greatest(block_number - 5, 0)'), ('reason', 'text', "'reorg'")])}
  else case when amount < 10 then '{{"type":"log","chain_id":'
    when amount < 20 then '{{"type":"log","block_number":7}}'
    when amount < 30 then '{{"type":"block","chain_id":1,"block_number":"7"}}'
    when amount < 40 then '{{"type":"uncle","chain_id":1,"block_number":7}}'
    when amount < 50 then '{{"type":"block","chain_id":1,"block_number":18446744073709551615}}'
    else '{{"chain_id":1,"block_number":7}}' end end as value
from ev""",
    "msg": f"""
select seq, topic, partition, "offset", micros, value as raw, strlen(value) as bytes, cents, user_id,
  case when type = '' then 'dead_letter' else type end as kind, type,
  case when type = '' then 0 else chain_id end as chain_id,
  case when type in ('', 'reorg') then 0 else block_number end as block_number,
  case when type in ('', 'reorg') then '' else block_hash end as block_hash, parent_hash,
  case when type = 'log' then {_word('chain_id')} when type in ('transaction', 'receipt') then {_word('user_id')}
    else '' end as tx_hash,
  case when type = 'log' then seq % 2 else 0 end as log_index,
  case when type = 'log' then {_word('user_id', 40)} else '' end as address,
  case when type = 'log' then {_word('cents')} else '' end as data,
  case when type = 'reorg' then greatest(block_number - 5, 0) else 0 end as from_block,
  case when type <> '' then null when amount < 10 then 'malformed json'
    when amount < 20 then 'chain_id is missing' when amount < 30 then 'field has the wrong json type'
    when amount < 40 then 'unknown message type' when amount < 50 then 'number exceeds bigint'
    else 'message type is missing' end as dead_reason,
  case when type <> '' then null when amount >= 30 and amount < 40 then 'apply' else 'decode' end as dead_stage
from raw""",
    "rg": "select chain_id, seq, from_block from msg where kind = 'reorg'",
    "alive": """
select * from msg m where kind not in ('reorg', 'dead_letter') and not exists (
  select 1 from rg r where r.chain_id = m.chain_id and r.seq > m.seq and r.from_block <= m.block_number)""",
    "wm": """
select chain_id, max(b) as last_processed_block from (
  select m.chain_id, m.block_number as b from msg m
  left join (select chain_id, max(seq) as s from rg group by chain_id) l using (chain_id)
  where m.kind not in ('reorg', 'dead_letter') and (l.s is null or m.seq > l.s)
  union all
  select chain_id, arg_max(from_block, seq) - 1 from rg group by chain_id having arg_max(from_block, seq) > 0
) group by chain_id""",
    "curlog": """
select * from (select *, row_number() over (
  partition by chain_id, block_hash, block_number, tx_hash, log_index order by seq) as rn
  from alive where kind = 'log') where rn = 1""",
    "curblock": """
select * from (select *, row_number() over (partition by chain_id, block_number order by seq desc) as rn
  from msg where kind = 'block') m where rn = 1 and not exists (
  select 1 from rg r where r.chain_id = m.chain_id and r.seq > m.seq and r.from_block <= m.block_number)""",
}

_WITH = "with " + ",\n".join(f"{name} as ({body.strip()})" for name, body in _CTES.items()) + "\n"


def _add(key: str, sql: str) -> None:
    ORACLE[key] = _WITH + sql.strip()


_LOG_COLUMNS = "chain_id, block_number, block_hash, tx_hash, log_index, address, data, topics, removed"

_NODE_OK = (
    "not (o_orderstatus = 'F' and o_orderpriority = '1-URGENT') "
    "and not (o_orderstatus = 'P' and o_orderpriority in ('2-HIGH', '3-MEDIUM'))"
)

#: orders of which the first part of a node's response cannot be read
_BAD_PART = "o_orderkey % 97 = 5"

# --- sources -----------------------------------------------------------------------------------
_add("src_rpc_blocks", f"""
select chain_id, o_orderkey as block_number, lower(block_hash) as block_hash, block_hash as parent_hash,
  cast(788918400 + block_number * 86400 as bigint) as timestamp, cast(30000000 as bigint) as gas_limit,
  cast(21000 + o_orderkey % 5000 as bigint) as gas_used, coalesce(n, 0) as tx_count
from o left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey
where {_NODE_OK} and not ({_BAD_PART} and coalesce(n, 0) > 0)""")
_add("src_rpc_transactions", f"""
select chain_id, {_word('o_orderkey * 1024 + seq - 1')} as tx_hash, ln.o_orderkey as block_number, block_hash,
  seq - 1 as tx_index, {_word('l_suppkey', 40)} as from_addr,
  case when l_linenumber < 7 then {_word('l_partkey', 40)} else '' end as to_addr,
  cast({_AMOUNT} as varchar) as value, cast(l_linenumber as bigint) as nonce,
  cast(21000 + l_partkey as bigint) as gas,
  case when l_linenumber = 1 then '0' else cast(l_partkey as varchar) end as gas_price, '0xAb' as input,
  cast(case when l_linenumber = 2 then 0 else 2 end as bigint) as tx_type
from ln join (select o_orderkey as k, o_orderstatus, o_orderpriority from orders) on k = o_orderkey
where {_NODE_OK} and not {_BAD_PART}""")
_add("src_rpc_receipts", f"""
select chain_id, tx_hash, block_number, block_hash, tx_index,
  cast(case o_orderstatus when 'O' then 1 else 0 end as bigint) as status,
  cast((1 + o_orderkey % 100) * 22000 as bigint) as cumulative_gas_used,
  cast(case when o_orderstatus = 'P' then 0 else 21000 + o_orderkey % 1000 end as bigint) as gas_used,
  case when to_addr is null then {_word('2000000 + o_orderkey', 40)} else '' end as contract_address,
  '0x00' as logs_bloom, cast(1000000000 + o_orderkey as varchar) as effective_gas_price from o""")
_add("src_rpc_logs", f"""
select chain_id, block_number, block_hash, tx_hash, (l_orderkey // 3) * 1024 + seq - 1 as log_index,
  {_word('l_suppkey', 40)} as address, '0x' || {_CENTS_HEX} as data,
  {_TOPIC0} || ',' || {_upper_word('l_partkey')} as topics, l_linestatus = 'F' as removed from ln where not {_BAD_PART}""")
_add("src_rpc_refused", f"""
select source, chain_id, 'invalid' as status, cast(1 as bigint) as bad_parts, n_parts
from o join (select l_orderkey, count(*) as n_parts from lineitem group by 1) on l_orderkey = o_orderkey,
  (values ('blocks'), ('logs')) s(source) where {_BAD_PART} and (source = 'logs' or {_NODE_OK})""")
_add("src_rpc_light_blocks", """
select chain_id, block_number, parent_hash, case when chain_id = 2 and block_number >= 2300
  then '0x' || sha256(block_hash) else block_hash end as block_hash
from bl where chain_id <> 3 or block_number < 2300""")
_add("src_rpc_heads", """
select chain_id, max(block_number) + 2 as latest_block from bl where block_number % 10 <> 3 group by chain_id""")
_add("src_rpc_envelope", f"""
select chain_id,
  case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'failed'
    when o_orderstatus = 'P' and o_orderpriority = '2-HIGH' then 'unavailable'
    when o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM' then 'failed' else 'ok' end as status,
  case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'busy' end as error,
  case when {_NODE_OK} then '0x' || lower(hex(o_orderkey)) end as number from o""")
_add("src_topics", "select topic, partition, \"offset\", micros, value from raw")
_INVENTORY = """
select 'logs' as source, chain_id, block_number, tx_hash || ':' || log_index as item from lg
union all select 'blocks', chain_id, block_number, block_hash from bl
union all select 'transactions', chain_id, block_number, tx_hash from tx
union all select 'receipts', chain_id, block_number, tx_hash from rc"""
_add("src_tables", _INVENTORY)

# --- sinks ---------------------------------------------------------------------------------------
_add("snk_encode_messages", f"""
select 'chain-logs-' || chain_id as topic, address as key, {_json([
    ('type', 'text', "'log'"), ('chain_id', 'uint', 'chain_id'), ('block_number', 'uint', 'block_number'),
    ('block_hash', 'text', 'block_hash'), ('tx_hash', 'text', 'tx_hash'), ('log_index', 'uint', 'log_index'),
    ('address', 'text', 'address'), ('data', 'text', 'data'), ('topics', 'list', 'topics'),
    ('removed', 'bool', 'removed')])} as value from lg
union all select 'chain-logs-' || chain_id, 'block:' || block_number, {_json([
    ('type', 'text', "'block'"), ('chain_id', 'uint', 'chain_id'), ('block_number', 'uint', 'block_number'),
    ('block_hash', 'text', 'block_hash'), ('parent_hash', 'text', 'parent_hash'), ('timestamp', 'uint', 'timestamp'),
    ('block_gas_limit', 'uint', 'gas_limit'), ('block_gas_used', 'uint', 'gas_used'),
    ('tx_count', 'uint', 'tx_count')])} from bl
union all select 'chain-logs-' || chain_id, tx_hash, {_json([
    ('type', 'text', "'transaction'"), ('chain_id', 'uint', 'chain_id'), ('block_number', 'uint', 'block_number'),
    ('block_hash', 'text', 'block_hash'), ('tx_hash', 'text', 'tx_hash'), ('tx_index', 'uint', 'tx_index'),
    ('from', 'text', 'from_addr'), ('to', 'text', 'to_addr'), ('value', 'text', 'value'), ('nonce', 'uint', 'nonce'),
    ('gas', 'uint', 'gas'), ('gas_price', 'text', 'gas_price'), ('input', 'text', 'input'),
    ('tx_type', 'uint', 'tx_type')])} from tx
union all select 'chain-logs-' || chain_id, tx_hash, {_json([
    ('type', 'text', "'receipt'"), ('chain_id', 'uint', 'chain_id'), ('block_number', 'uint', 'block_number'),
    ('block_hash', 'text', 'block_hash'), ('tx_hash', 'text', 'tx_hash'), ('tx_index', 'uint', 'tx_index'),
    ('status', 'uint', 'status'), ('cumulative_gas_used', 'uint', 'cumulative_gas_used'),
    ('receipt_gas_used', 'uint', 'gas_used'), ('contract_address', 'text', 'contract_address'),
    ('logs_bloom', 'text', 'logs_bloom'), ('effective_gas_price', 'text', 'effective_gas_price')])} from rc
union all select 'chain-logs-' || chain_id, 'reorg', {_json([
    ('type', 'text', "'reorg'"), ('chain_id', 'uint', 'chain_id'), ('from_block', 'uint', 'f'),
    ('reason', 'text', "'reorg'")])}
from (select chain_id, max(case when same then block_number end) + 1 as f from cmp group by chain_id)""")
_add("snk_logs_append", f"""
select {_LOG_COLUMNS} from lgt union all select {_LOG_COLUMNS} from lgt where removed""")
_FIRST = """
select chain_id, block_number, block_hash, tx_hash, log_index, address, seq, source from (
  select *, row_number() over (partition by chain_id, block_hash, block_number, tx_hash, log_index
    order by {order}) as rn from dl {where}) where rn = 1"""
_NEW = _FIRST.format(order="seq", where="""where source <> 'A' and not exists (select 1 from dl s
  where s.source = 'A' and s.chain_id = dl.chain_id and s.tx_hash = dl.tx_hash and s.log_index = dl.log_index
  and s.block_hash = dl.block_hash and s.block_number = dl.block_number)""")
_add("snk_logs_insert_ignore", _FIRST.format(order="source <> 'A', seq", where=""))
_LAST = "select * exclude (rn) from (select *, row_number() over (partition by {key} order by seq desc) as rn from {src}) where rn = 1"
_add("snk_blocks_upsert", _LAST.format(key="chain_id, block_number", src="blv"))
_add("snk_transactions_upsert", f"""
select chain_id, lower(tx_hash) as tx_hash, block_number, lower(block_hash) as block_hash, tx_index,
  lower(from_addr) as from_addr, nullif(lower(to_addr), '') as to_addr, coalesce(nullif(value, ''), '0') as value,
  nonce, gas, coalesce(nullif(gas_price, ''), '0') as gas_price, input, tx_type, seq
from ({_LAST.format(key="chain_id, tx_hash", src="txv")})""")
_add("snk_receipts_upsert", f"""
select chain_id, lower(tx_hash) as tx_hash, block_number, lower(block_hash) as block_hash, tx_index, status,
  cumulative_gas_used, gas_used, nullif(lower(contract_address), '') as contract_address, logs_bloom,
  coalesce(nullif(effective_gas_price, ''), '0') as effective_gas_price, seq
from ({_LAST.format(key="chain_id, tx_hash", src="rcv")})""")
_add("snk_balance_delta", """
select chain_id, address, cast(sum(balance) as varchar) as balance from bal group by chain_id, address""")
_BALANCES = "select chain_id, address, cast(balance as varchar) as balance from bal where topic0 = '{topic}'"
_add("snk_reset_balances", _BALANCES.format(topic=_A) + " and chain_id <> 2")
_add("snk_delete_from", f"select * from ({_INVENTORY}) where not (chain_id = 2 and block_number >= 1200)")
_add("snk_state_set", """
select chain_id, arg_max(block_number, seq) as last_processed_block from msg where kind = 'block' group by chain_id""")
_add("snk_state_clear", "select * from wm where chain_id <> 2")
_add("tbl_evolve", "select * replace (case when chain_id = 1 then 0 else tx_count end as tx_count) from bl")

# --- projections and filters -------------------------------------------------------------------------
_add("prj_decode_message", """
select seq, kind, type, chain_id, block_number, tx_hash, log_index, address, data, from_block, dead_reason from msg""")
_add("prj_route", "select kind, chain_id, seq from msg where kind <> 'dead_letter'")
_add("prj_to_log", f"select {_LOG_COLUMNS} from lgt")
_add("prj_to_block", "select * from bl")
_add("prj_to_transaction", "select * replace (coalesce(to_addr, '') as to_addr) from tx")
_add("prj_to_receipt", "select * replace (coalesce(contract_address, '') as contract_address) from rc")
_add("flt_logs", f"""
select {_LOG_COLUMNS} from lgt where chain_id = 2 and address = lower('{SUPPLIER}')
  and block_number >= 300 and block_number <= 1800""")
_add("flt_transactions", f"""
select * from tx where (from_addr = lower('{RECIPIENT}') or to_addr = lower('{RECIPIENT}'))
  and block_number >= 100 and block_number <= 2000""")
_add("flt_balances", _BALANCES.format(topic=_A) + " and chain_id = 1")
_add("flt_logs_after", f"""
select {_LOG_COLUMNS} from lgt where chain_id = 2 and (block_number > 1000 or (block_number = 1000 and log_index > 500))
order by block_number, log_index, chain_id, tx_hash limit 1000""")
_add("flt_block_hash", """
select b.chain_id, b.block_number, b.block_hash from bl b
join (select distinct chain_id, block_number + 1 as block_number from o) w using (chain_id, block_number)""")
_add("flt_ingest", f"select {_LOG_COLUMNS} from lgt where address = lower('{SUPPLIER}') and topic0 = '{_A}'")
_add("flt_event_id", f"select {_LOG_COLUMNS} from lgt where topic0 = '{_A}'")
_add("flt_dead_letter", "select seq, topic, raw, dead_stage, dead_reason from msg where kind = 'dead_letter'")
_add("flt_chain_mismatch", """
select seq, topic, chain_id, topic <> 'chain-logs-' || chain_id as chain_mismatch from msg where kind <> 'dead_letter'""")

# --- joins -----------------------------------------------------------------------------------------------
_add("jn_tx_receipt", """
select tx.* exclude (input), r.status, r.gas_used, r.cumulative_gas_used, r.contract_address, r.effective_gas_price
from tx join rc r using (chain_id, tx_hash)""")
_add("jn_tx_missing_receipt", """
select chain_id, block_number, count(*) as missing from tx
where not exists (select 1 from rc where rc.chain_id = tx.chain_id and rc.tx_hash = tx.tx_hash) group by 1, 2""")
_add("jn_reorg_compare", "select * from cmp")
_add("jn_insert_ignore", _NEW)
_add("jn_reorg_invalidate", "select chain_id, block_number, seq, kind from alive")
_STATE = """
select c.chain_id, coalesce(last_processed_block, 0) as last_processed_block,
  last_processed_block is not null as has_state
from (select unnest([1, 2, 3, {extra}])::bigint as chain_id) c left join wm using (chain_id)"""
_add("jn_state_chains", _STATE.format(extra=4))
_add("jn_block_range_state", """
select 2::bigint as chain_id, min(block_number) as min_block, max(block_number) as max_block, true as has_blocks,
  (select last_processed_block from wm where chain_id = 2) as last_processed_block, true as has_state
from bl where chain_id = 2""")

# --- aggregations ----------------------------------------------------------------------------------------
_add("agg_balances", _BALANCES.format(topic=_A))
_add("agg_balances_rebuild", _BALANCES.format(topic=_N) + " and chain_id <> 2 union all "
     + _BALANCES.format(topic=_A) + " and chain_id = 2")
_SUMMARY = "select chain_id, tx_hash, min(block_number) as block_number, count(*) as log_count from lg {where} group by 1, 2"
_add("agg_tx_summary", _SUMMARY.format(where=""))
_add("agg_block_range", "select min(block_number) as min_block, max(block_number) as max_block, true as has_blocks from bl")
_LIVE = "from msg where kind <> 'dead_letter'"
_add("agg_batch_max_block", f"select chain_id, max(block_number) as max_block {_LIVE} group by 1 having max(block_number) > 0")
_add("agg_offset_range", f"select partition, min(\"offset\") as min_offset, max(\"offset\") as max_offset {_LIVE} group by 1")
_add("agg_batch_counts", f"""
select count(*) as messages, count(*) filter (kind = 'log') as logs, count(*) filter (kind = 'block') as blocks,
  count(*) filter (kind = 'transaction') as transactions, count(*) filter (kind = 'receipt') as receipts {_LIVE}""")
_add("agg_tx_count", "select chain_id, block_number, count(*) as tx_count from tx group by 1, 2")
_add("agg_last_processed", "select max(last_processed_block) as last_processed_block from wm")
_add("agg_topic_messages", """
select topic, partition, count(*) as messages from msg group by grouping sets ((topic), (topic, partition))""")
_NOW = "epoch_us(timestamp '2024-02-01 00:00:00')"
_add("agg_partition_max_lag", f"""
select topic, partition, max({_NOW} - micros) / 1e6::double as max_lag_seconds
from msg group by grouping sets ((), (topic, partition))""")
_add("agg_last_message", """
select topic, partition, "offset", cast(bytes as integer) as bytes, micros from msg order by micros desc, "offset" desc limit 1""")
_add("agg_errors", "select dead_stage, dead_reason, count(*) as errors from msg where kind = 'dead_letter' group by 1, 2")
_HEIGHTS = """
select h as latest_block, l as last_processed_block, case when l > 0 and h >= l then h - l else 0 end as block_lag
from (select max(latest_block) as h from hd), (select max(last_processed_block) as l from wm)"""
_add("agg_block_lag", _HEIGHTS)

# --- writers, fork point -------------------------------------------------------------------------------------
_add("win_last_writer", _LAST.format(key="chain_id, tx_hash", src="txv"))
_add("win_first_writer", _FIRST.format(order="seq", where=""))
_add("win_fork_point", """
select chain_id, max(block_number) as tip, max(case when same then block_number end) as fork_block
from cmp group by chain_id""")

# --- sorts, limits, gaps ----------------------------------------------------------------------------------------
_add("srt_logs_ingest", f"select {_LOG_COLUMNS} from lgt")
_add("top_logs", f"select {_LOG_COLUMNS} from lgt order by block_number, log_index, chain_id, tx_hash limit 1000")
_add("top_transactions", "select * from tx order by block_number, tx_index, chain_id, tx_hash limit 1000")
_add("top_balances", _BALANCES.format(topic=_A) + " order by chain_id, address limit 1000")
_add("top_tx_summary", _SUMMARY.format(where="where block_number >= 50") + " order by 3, 1, 2 limit 100")
_add("rng_coverage_gaps", """
select chain_id, block_number from (
  select chain_id, unnest(generate_series(0, latest_block + 10)) as block_number from hd) p
where not exists (select 1 from bl where bl.chain_id = p.chain_id and bl.block_number = p.block_number)""")

# --- set operations -----------------------------------------------------------------------------------------------
_add("set_merge_chunks", f"select {_LOG_COLUMNS} from lgt")
_add("set_union_chains", "select seq, topic, partition, \"offset\" from raw")

# --- streaming ----------------------------------------------------------------------------------------------------
_add("st_confirmed_ingest", """
select b.chain_id, b.block_number, b.block_hash from bl b join (
  select chain_id, case when chain_id = 1 then 5 else latest_block - 99 end as f, latest_block - 12 as head from hd) r
  using (chain_id) where b.block_number between r.f and least(r.f + 499, r.head)""")
_add("st_apply_batch", "select seq, kind, chain_id, block_number, dead_reason from msg")
_add("st_reorg_barrier", f"""
select chain_id, block_number, block_hash, tx_hash, log_index, address, '0x' || substring(data, 3) as data,
  '{_A},' || {_word('user_id')} as topics, false as removed from curlog""")
_add("st_reorg_detect", """
select chain_id, max(block_number) as tip, 'reorg' as status,
  max(case when same then block_number end) + 1 as from_block,
  max(case when same then block_number end) as last_processed_block from cmp group by chain_id""")
_NODE = """
select chain_id, max(block_number) as tip,
  case chain_id when 1 then 'ok' when 2 then 'reorg' else 'unavailable' end as status,
  case when chain_id = 2 then max(block_number) filter (where block_number < 2300) + 1 end as from_block,
  case when chain_id = 2 then max(block_number) filter (where block_number < 2300)
    else max(block_number) end as last_processed_block from bl group by chain_id
union all select 4, max(block_number), 'unchecked', null, max(block_number) from bl where chain_id = 1"""
_add("st_reorg_detect_node", _NODE)
_add("st_reorg_detect_tip", _NODE)
_add("win_parent_link", """
select b.chain_id, b.block_number, lower(p.block_hash) = lower(b.parent_hash) as linked
from bl b left join bl p on p.chain_id = b.chain_id and p.block_number = b.block_number - 1""")
_add("win_cumulative_gas_check", """
select chain_id, block_number, tx_index, tx_hash, gas_sum, gas_sum = cumulative_gas_used as agrees
from (select *, cast(sum(gas_used) over (partition by chain_id, block_number order by tx_index) as bigint) as gas_sum from rc)""")
_add("st_watermark", "select * from wm")
_add("st_balance_incremental", f"""
select chain_id, {_word('user_id', 40)} as address, cast(sum(cents) as varchar) as balance
from curlog where cents <> 0 group by 1, 2""")
_add("st_dedupe", "select distinct chain_id, block_hash, block_number, tx_hash, log_index from dl")
_add("st_dedupe_stream", """
select distinct chain_id, block_hash, block_number, tx_hash, log_index from dl
union all select distinct chain_id, block_hash, block_number, tx_hash, log_index from dl where source = 'A'""")
_add("st_replay", """
select chain_id, block_number, block_hash, parent_hash, 1704067200 + block_number as timestamp,
  30000000::bigint as gas_limit, cents as gas_used, seq % 10 as tx_count from curblock""")

_add("st_confirmed_publish", """
select b.chain_id, b.block_number, b.block_hash, b.tx_count from bl b join (
  select chain_id, case when chain_id = 1 then 5 else latest_block - 99 end as f, latest_block - 12 as head from hd) r
  using (chain_id) where b.block_number between r.f and least(r.f + 599, r.head)""")
_STORED_LOGS = f"""
select chain_id, block_number, block_hash, tx_hash, log_index, address, '0x' || substring(data, 3) as data,
  '{_A},' || {_word('user_id')} as topics, false as removed from curlog"""
_MOVED = """
select * from (select *, row_number() over (partition by chain_id, tx_hash order by seq desc) as rn
  from msg where kind = '{kind}') m where rn = 1 and not exists (
  select 1 from rg r where r.chain_id = m.chain_id and r.seq > m.seq and r.from_block <= m.block_number)"""
_STORED_TRANSACTIONS = f"""
select chain_id, tx_hash, block_number, block_hash, seq % 10 as tx_index, {_word('user_id', 40)} as from_addr,
  null::varchar as to_addr, cast(cents as varchar) as value, seq % 7 as nonce, 21000::bigint as gas, '0' as gas_price,
  '' as input, 0::bigint as tx_type from ({_MOVED.format(kind='transaction')})"""
_add("st_stored_logs", _STORED_LOGS)
_add("st_stored_blocks", """
select chain_id, block_number, block_hash, parent_hash, 1704067200 + block_number as timestamp,
  30000000::bigint as gas_limit, cents as gas_used, seq % 10 as tx_count from curblock""")
_add("st_stored_transactions", _STORED_TRANSACTIONS)
_add("st_stored_receipts", f"""
select chain_id, tx_hash, block_number, block_hash, seq % 10 as tx_index, seq % 2 as status, 0::bigint as cumulative_gas_used,
  21000::bigint as gas_used, null::varchar as contract_address, '' as logs_bloom, cast(cents as varchar) as effective_gas_price
from ({_MOVED.format(kind='receipt')})""")
_add("q_logs_stored", f"""
select * from ({_STORED_LOGS}) where chain_id = 2 and block_number >= 100
order by block_number, log_index, chain_id, tx_hash, block_hash limit 500""")
_add("q_transactions_stored", f"""
select * replace ('' as to_addr) from ({_STORED_TRANSACTIONS}) where from_addr = '0x' || lpad('5', 40, '0')""")

# --- query endpoints -----------------------------------------------------------------------------------------------
_add("q_logs", f"""
select {_LOG_COLUMNS} from lgt where chain_id = 1 and block_number >= 100
order by block_number, log_index, chain_id, tx_hash limit 500""")
_add("q_transactions", f"""
select * replace (coalesce(to_addr, '') as to_addr) from tx
where from_addr = lower('{RECIPIENT}') or to_addr = lower('{RECIPIENT}')
order by block_number, tx_index, chain_id, tx_hash limit 100""")
_add("q_balances", _BALANCES.format(topic=_A) + " and chain_id = 3 order by chain_id, address limit 1000")
_add("q_state", _STATE.format(extra=31337))
_add("q_blocks", """
select null::bigint as chain_id, min(block_number) as min_block, max(block_number) as max_block, true as has_blocks,
  0::bigint as last_processed_block, false as has_state from bl""")
_add("q_reindex", "select * from wm where chain_id <> 2 union all select 2, 499")
_add("q_metrics", f"""
, lastm as (select * from msg order by micros desc, "offset" desc limit 1),
heights as ({_HEIGHTS}),
agg as (select count(*) as n, count(*) filter (kind = 'log') as logs, min(block_number) filter (kind = 'log') as f,
  max(block_number) filter (kind = 'log') as t, count(*) filter (dead_stage = 'decode') as d,
  count(*) filter (dead_stage = 'apply') as a, min(micros) as oldest from msg)
select * from (
  select 'last_batch_from' as metric, null::varchar as topic, null::integer as partition, f::bigint as value from agg
  union all select 'last_batch_to', null, null, t from agg
  union all select 'last_batch_count', null, null, logs from agg
  union all select 'logs_total', null, null, logs from agg
  union all select 'messages_total', null, null, n from agg
  union all select 'decode_errors_total', null, null, d from agg
  union all select 'apply_errors_total', null, null, a from agg
  union all select 'commit_errors_total', null, null, 0
  union all select 'fetch_errors_total', null, null, 0
  union all select 'last_partition', null, null, partition from lastm
  union all select 'last_offset', null, null, "offset" from lastm
  union all select 'last_bytes', null, null, bytes from lastm
  union all select 'last_timestamp_seconds', null, null, micros // 1000000 from lastm
  union all select 'last_lag_seconds', null, null, cast(round_even(({_NOW} - micros) / 1e6::double, 0) as bigint) from lastm
  union all select 'max_lag_seconds', null, null, cast(round_even(({_NOW} - oldest) / 1e6::double, 0) as bigint) from agg
  union all select 'last_topic', topic, null, 1 from lastm
  union all select 'topic_messages_total', topic, null, count(*) from msg group by topic
  union all select 'partition_messages_total', topic, partition, count(*) from msg group by topic, partition
  union all select 'partition_max_lag_seconds', topic, partition,
    cast(round_even(({_NOW} - min(micros)) / 1e6::double, 0) as bigint) from msg group by topic, partition
  union all select 'uptime_seconds', null, null, 3600
  union all select 'latest_block', null, null, latest_block from heights
  union all select 'last_processed_block', null, null, last_processed_block from heights
  union all select 'block_lag', null, null, block_lag from heights)""")
