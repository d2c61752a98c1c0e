"""Messages: decode, check, route, project and encode.

``decode`` turns Kafka-shaped rows (topic, partition, offset, timestamp, value) into
changelog rows. Undecodable rows stay in the same frame as dead letters with a stage
and a reason, so one scan and one write serve both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas as S
from ledgerloom.functions.once import compute_once

# --- fixed values: reasons a message is set aside, first match wins ----------------------
MALFORMED = "malformed json"
BAD_FIELD = "field has the wrong json type"
OUT_OF_RANGE = "number exceeds bigint"
MISSING_TYPE = "message type is missing"
MISSING_CHAIN = "chain_id is missing"
UNKNOWN_TYPE = "unknown message type"


def _strict_types() -> str:
    """Regex of a field whose JSON value has a type the envelope does not allow.

    ``from_json`` would accept "7", 1.5 or -1 for a number and 5 for a string. A quote
    inside JSON text is always escaped, so the quoted field names cannot match there.
    """
    text = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    allowed = {
        "uint": r"(?:\d++(?=\s*[,}])|null)",
        "string": r'(?:"|null)',
        "bool": r"(?:true|false|null)",
        "array": rf"(?:null|\[\s*(?:(?:{text}|null)\s*(?:,\s*(?:{text}|null)\s*)*)?\])",
    }
    parts = []
    for kind, pattern in allowed.items():
        names = "|".join(S.envelope_fields(kind))
        parts.append(rf'(?:{names})"\s*+:\s*+(?!{pattern})')
    # One leading quote for all alternatives lets the engine skip every other character, and what cannot be a field name is
    # passed over before any name is tried.
    return rf'"(?=[a-z_]++"\s*+:)(?:{"|".join(parts)})'


# A brace closes before the text does: the message holds an object, or something follows it.
_INNER_BRACE = r"\}\s*+\S"


def _top_level() -> str:
    """SQL of the message as a VARIANT, NULL if the text is not exactly one JSON value.

    The parser stops where the first value ends, so the text is parsed as the first of two elements; the second, a hash of
    the text, must come out as the last one. A field name that occurs twice in an object makes the value NULL.
    """
    both = "try_cast(try_parse_json(concat('[', raw, ',\"', sha2(raw, 256), '\"]')) as array<variant>)"
    return f"get(get(filter(array({both}), a -> size(a) = 2 and try_variant_get(get(a, 1), '$', 'string') = sha2(raw, 256)), 0), 0)"


def _wrong_top_level(name: str, kind: str) -> str:
    """SQL that is true if a field of the VARIANT ``v`` has a JSON type the envelope does not allow."""
    found = f"try_variant_get(v, '$.{name}', 'variant')"
    found_type = f"schema_of_variant({found})"
    right = {
        "string": f"{found_type} = 'STRING'",
        "bool": f"{found_type} = 'BOOLEAN'",
        # 1.0 is a decimal as well; only whole numbers beyond BIGINT have as many digits
        "uint": f"({found_type} = 'BIGINT' and try_variant_get(v, '$.{name}', 'bigint') >= 0) or {found_type} in ('DECIMAL(19,0)', 'DECIMAL(20,0)')",
        "array": f"startswith({found_type}, 'ARRAY') and forall(try_cast({found} as array<variant>), x -> coalesce(schema_of_variant(x), 'VOID') in ('STRING', 'VOID'))",
    }
    return f"({found} is not null and {found_type} <> 'VOID' and not coalesce({right[kind]}, false))"


def _nested_fault() -> str:
    """SQL of what is wrong with a message that has a brace inside; NULL if nothing is."""
    wrong = " or ".join(_wrong_top_level(name, kind) for name, kind in S.ENVELOPE_FIELDS)
    return f"get(transform(array({_top_level()}), v -> case when v is null then '{MALFORMED}' when {wrong} then '{BAD_FIELD}' end), 0)"


def _beyond_bigint() -> Column:
    """Whether a message that does not parse with BIGINT numbers is JSON with a number of up to 20 digits that is too large."""
    names = "|".join(S.envelope_fields("uint"))
    found = F.regexp_extract_all("raw", F.lit(rf'"(?:{names})"\s*+:\s*+(\d{{19,20}}+)(?!\d)'), F.lit(1))
    return F.json_object_keys("raw").isNotNull() & F.exists(found, lambda n: (F.length(n) == 20) | (n > str(S.MAX_BIGINT)))


def decode(raw: DataFrame, seq: Column | str = "offset") -> DataFrame:
    """Changelog rows of raw messages.

    Envelope columns are never NULL: an absent field is zero, '' or false. The message
    coordinates become ``topic, partition, offset, message_time, bytes``; ``seq`` orders
    the messages of a chain (see ``arrival_order`` for topics with several partitions).
    ``kind`` is the message type or ``dead_letter``; dead letters keep ``raw``. Unknown fields are ignored, whatever they
    hold; text after the message makes it malformed.

    Flat messages, all that writers of this format make, are judged by patterns over the text. A message with a brace
    inside is parsed once more into a VARIANT, which tells fields of the message from those of objects in it. Numbers are
    parsed as BIGINT; only a message that does not parse with these is searched for one that is too large.
    """
    order = F.col(seq) if isinstance(seq, str) else seq
    text = F.col("value").cast("string")
    fields = [T.StructField(f.name, T.LongType() if kind == "uint" else f.dataType) for f, (_, kind) in zip(S.ENVELOPE.fields, S.ENVELOPE_FIELDS)]
    schema = T.StructType([*fields, T.StructField("_corrupt", T.StringType())])
    coordinates = raw.select(
        order.alias("seq"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("message_time"),
        F.octet_length(text).alias("bytes"),
        text.alias("raw"),
    )
    parsed = compute_once(
        coordinates,
        ["*"],
        [
            F.from_json("raw", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("m"),
            F.when(F.col("raw").rlike(_INNER_BRACE), F.expr(_nested_fault()))
            .when(F.col("raw").rlike(_strict_types()), BAD_FIELD)
            .alias("fault"),
        ],
    )
    trimmed = F.trim("raw")
    reason = (
        F.when(
            F.col("raw").isNull()
            | ~(trimmed.startswith("{") & trimmed.endswith("}"))
            | F.col("m").isNull()
            | F.coalesce(F.col("fault") == MALFORMED, F.lit(False)),
            MALFORMED,
        )
        .when(F.col("fault") == BAD_FIELD, BAD_FIELD)
        .when(F.col("m._corrupt").isNotNull() & _beyond_bigint(), OUT_OF_RANGE)
        .when(F.col("m._corrupt").isNotNull(), MALFORMED)
        .when(F.coalesce(F.col("m.type"), F.lit("")) == "", MISSING_TYPE)
        .when(F.coalesce(F.col("m.chain_id"), F.lit(0)) == 0, MISSING_CHAIN)
        .when(~F.col("m.type").isin(*S.MESSAGE_TYPES), UNKNOWN_TYPE)
    )
    checked = parsed.withColumn("dead_reason", reason)
    good = "dead_reason is null"
    return checked.selectExpr(
        f"case when {good} then m.type else '{S.DEAD_LETTER}' end as kind",
        "seq", "topic", "partition", "offset", "message_time", "bytes",
        *[_field_sql(name, kind, good) for name, kind in S.ENVELOPE_FIELDS],
        f"case when not ({good}) then raw end as raw",
        f"case when dead_reason = '{UNKNOWN_TYPE}' then 'apply' when not ({good}) then 'decode' end as dead_stage",
        "dead_reason",
    )


def _field_sql(name: str, kind: str, good: str) -> str:
    """An envelope field with its zero value for an absent field or a dead letter."""
    zero = {"string": "''", "uint": "0L", "bool": "false", "array": "cast(array() as array<string>)"}
    value = f"case when {good} then m.`{name}` end"
    return f"coalesce({value}, {zero[kind]}) as `{name}`"


def arrival_order() -> Column:
    """Order of messages spread over several partitions: time, then partition, then offset.

    One DECIMAL(38,0): milliseconds, six digits of partition, nineteen of offset.
    """
    return F.expr(
        "cast(unix_millis(timestamp) as decimal(38,0)) * 10000000000000000000000000BD "
        "+ cast(partition as decimal(10,0)) * 10000000000000000000BD + offset"
    ).cast("decimal(38,0)")


def accepted(changelog: DataFrame) -> DataFrame:
    return changelog.where(F.col("kind") != S.DEAD_LETTER)


def dead_letters(changelog: DataFrame) -> DataFrame:
    return changelog.where(F.col("kind") == S.DEAD_LETTER).select(
        "seq", "topic", "partition", "offset", "message_time", "raw", "dead_stage", "dead_reason"
    )


def route(changelog: DataFrame) -> dict[str, DataFrame]:
    """One frame per message type. On a stored changelog each filter prunes partitions."""
    return {kind: changelog.where(F.col("kind") == kind) for kind in S.MESSAGE_TYPES}


def chain_mismatch(changelog: DataFrame, prefix: str) -> DataFrame:
    """Flag messages whose chain differs from the chain of their topic; they stay accepted."""
    expected = F.concat(F.lit(f"{prefix}-"), F.col("chain_id").cast("string"))
    return changelog.withColumn("chain_mismatch", F.col("topic") != expected)


def _project(changelog: DataFrame, kind: str, extra: list[str], columns: list) -> DataFrame:
    return changelog.where(F.col("kind") == kind).select(*extra, *columns)


def to_logs(changelog: DataFrame, *extra: str) -> DataFrame:
    return _project(changelog, S.LOG, list(extra), S.LOGS.fieldNames())


def to_blocks(changelog: DataFrame, *extra: str) -> DataFrame:
    renamed = {"gas_limit": "block_gas_limit", "gas_used": "block_gas_used"}
    columns = [F.col(renamed.get(c, c)).alias(c) for c in S.BLOCKS.fieldNames()]
    return _project(changelog, S.BLOCK, list(extra), columns)


def to_transactions(changelog: DataFrame, *extra: str) -> DataFrame:
    renamed = {"from_addr": "from", "to_addr": "to"}
    columns = [F.col(renamed.get(c, c)).alias(c) for c in S.TRANSACTIONS.fieldNames()]
    return _project(changelog, S.TRANSACTION, list(extra), columns)


def to_receipts(changelog: DataFrame, *extra: str) -> DataFrame:
    renamed = {"gas_used": "receipt_gas_used"}
    columns = [F.col(renamed.get(c, c)).alias(c) for c in S.RECEIPTS.fieldNames()]
    return _project(changelog, S.RECEIPT, list(extra), columns)


# --- encoding ---------------------------------------------------------------------------

def _encode(rows: DataFrame, kind: str, renamed: dict[str, str], key: Column, prefix: str,
            extra: list[str]) -> DataFrame:
    """(topic, key, value) rows; zero values are left out of the JSON text."""
    kinds = dict(S.ENVELOPE_FIELDS)
    zero = {"string": F.lit(""), "uint": F.lit(0), "bool": F.lit(False)}
    source = {renamed.get(c, c): c for c in rows.columns}
    fields = [F.lit(kind).alias("type")]
    for name, field_kind in S.ENVELOPE_FIELDS[1:]:
        if name not in source:
            continue
        value = F.col(source[name])
        if name == "chain_id":
            required = F.raise_error(F.lit("chain_id is required"))
            value = F.when(F.coalesce(value, F.lit(0)) == 0, required).otherwise(value)
        elif field_kind == "array":
            value = F.when(F.size(value) > 0, value)
        else:
            value = F.nullif(value, zero[kinds[name]])
        fields.append(value.alias(name))
    topic = F.concat(F.lit(f"{prefix}-"), F.col("chain_id").cast("string"))
    return rows.select(
        *extra,
        topic.alias("topic"),
        key.alias("key"),
        F.to_json(F.struct(*fields)).alias("value"),
    )


def encode_logs(logs: DataFrame, prefix: str, *extra: str) -> DataFrame:
    return _encode(logs, S.LOG, {}, F.col("address"), prefix, list(extra))


def encode_blocks(blocks: DataFrame, prefix: str, *extra: str) -> DataFrame:
    key = F.concat(F.lit("block:"), F.col("block_number").cast("string"))
    renamed = {"gas_limit": "block_gas_limit", "gas_used": "block_gas_used"}
    return _encode(blocks, S.BLOCK, renamed, key, prefix, list(extra))


def encode_transactions(transactions: DataFrame, prefix: str, *extra: str) -> DataFrame:
    renamed = {"from_addr": "from", "to_addr": "to"}
    return _encode(transactions, S.TRANSACTION, renamed, F.col("tx_hash"), prefix, list(extra))


def encode_receipts(receipts: DataFrame, prefix: str, *extra: str) -> DataFrame:
    renamed = {"gas_used": "receipt_gas_used"}
    return _encode(receipts, S.RECEIPT, renamed, F.col("tx_hash"), prefix, list(extra))


def encode_reorgs(reorgs: DataFrame, prefix: str, *extra: str) -> DataFrame:
    """Reorg markers (chain_id, from_block, reason)."""
    return _encode(reorgs, S.REORG, {}, F.lit("reorg"), prefix, list(extra))
