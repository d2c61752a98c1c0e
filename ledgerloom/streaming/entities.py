"""Stored tables of logs, blocks, transactions and receipts, kept up to date batch by batch.

A batch rewrites the (chain, bucket) folders it touches and no others, each from the changelog, so duplicates, reorgs and
repeated batches come out as they would in a replay. It touches the buckets of its rows, those from a reorg marker's
block upwards, and, as a transaction or receipt may move to another block, the buckets that its hash was in before. For
these, ``homes`` maps each hash to the buckets it was seen in, and ``moves`` holds the hashes seen in several, with the
order number of each: a version is hidden by a later one wherever that lies. New folders are written first; the manifest
then names what is live, so readers see whole batches.

An index of (value, chain, bucket), sorted by value, tells which buckets hold an address or a hash. Buckets are the unit:
an index entry counts if the folder it was written with is live.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas as S
from ledgerloom.operators import messages as M
from ledgerloom.operators import reorg as R
from ledgerloom.operators import writers as W
from ledgerloom.sources.tables import BLOCK_BUCKET
from ledgerloom.streaming import jobs
from ledgerloom.streaming import manifest as L

FOLDER = ("chain_id", "block_bucket")
#: version numbers between two batches, for rebuilds
STEP = 1024
#: parts of a level that are merged into one of the next; readers open fewer than this of each level
FAN = 8


@dataclass(frozen=True)
class Entity:
    kind: str
    schema: T.StructType
    position: str
    indexed: tuple[str, ...]
    moves: bool = False

    def rows(self, changelog: DataFrame) -> DataFrame:
        return {S.LOG: M.to_logs, S.BLOCK: M.to_blocks, S.TRANSACTION: M.to_transactions, S.RECEIPT: M.to_receipts}[self.kind](changelog, "seq", "block_bucket")


ENTITIES = {
    "logs": Entity(S.LOG, S.LOGS, "log_index", ("address", "tx_hash")),
    "blocks": Entity(S.BLOCK, S.BLOCKS, "block_hash", ()),
    "transactions": Entity(S.TRANSACTION, S.TRANSACTIONS, "tx_index", ("tx_hash", "from_addr", "to_addr"), moves=True),
    "receipts": Entity(S.RECEIPT, S.RECEIPTS, "tx_index", ("tx_hash",), moves=True),
}
_HOME = [("kind", T.StringType()), ("chain_id", T.LongType()), ("tx_hash", T.StringType()), ("block_bucket", T.LongType())]
_INDEX = T.StructType([T.StructField(n, t) for n, t in (
    ("value", T.StringType()), ("chain_id", T.LongType()), ("block_bucket", T.LongType()), ("made", T.LongType()), ("field", T.StringType()),
)])


def _home(changelog: DataFrame) -> T.StructType:
    return T.StructType([*(T.StructField(n, t) for n, t in _HOME), T.StructField("seq", changelog.schema["seq"].dataType)])


def _any_of(folders: set[tuple[int, int]]) -> Column:
    """A filter on partition columns; it counts folders, not rows."""
    by_chain: dict[int, list[int]] = {}
    for chain, bucket in sorted(folders):
        by_chain.setdefault(chain, []).append(bucket)
    wanted = F.lit(False)
    for chain, buckets in by_chain.items():
        wanted = wanted | ((F.col("chain_id") == chain) & F.col("block_bucket").isin(buckets))
    return wanted


def _read_parts(spark: SparkSession, root: str, name: str, schema, parts: list[dict]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    places = [f"{root}/{name}/part={p['part']}" for p in parts]
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*places).select(*schema.fieldNames())


def _write_part(rows: DataFrame, path: str, folders: tuple[str, ...], order: tuple[str, ...]) -> None:
    """Sorted by key over all its files, so that statistics tell readers which to pass over."""
    spread = rows.repartitionByRange(*folders, *order).sortWithinPartitions(*folders, *order)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*folders).parquet(path)


def _merged(spark: SparkSession, root: str, name: str, schema, parts: list[dict], version: int, reduce, folders, order) -> list[dict]:
    """The parts of a sorted table after merging ``FAN`` of a level wherever there are so many: each row is rewritten once a level."""
    while True:
        full = next((k for k in sorted({p["level"] for p in parts}) if sum(p["level"] == k for p in parts) >= FAN), None)
        if full is None:
            return parts
        old = [p for p in parts if p["level"] == full]
        part = {"table": name, "part": f"{version}-{full + 1}", "level": full + 1}
        _write_part(reduce(_read_parts(spark, root, name, schema, old)), f"{root}/{name}/part={part['part']}", folders, order)
        parts = [p for p in parts if p["level"] != full] + [part]


def _parts(entries: list[dict], name: str) -> list[dict]:
    return [e for e in entries if e["table"] == name and "part" in e]


def _latest_places(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", *S.TX_KEY, "block_bucket").agg(F.max("seq").alias("seq"))


def _moved(spark: SparkSession, changelog: DataFrame, root: str, version: int, batch: Column, entries: list[dict]) -> tuple[set[tuple[str, int, int]], list[dict]]:
    """Note where the hashes of a batch lie. Returns the folders (kind, chain, bucket) of those in several, and the parts."""
    schema = _home(changelog)
    kinds = [e.kind for e in ENTITIES.values() if e.moves]
    rows = changelog.where(batch & F.col("kind").isin(kinds)).withColumn("tx_hash", F.lower("tx_hash"))
    folders, order, key = ("kind", "chain_id"), ("tx_hash",), ["kind", *S.TX_KEY]
    new = {n: {"table": n, "part": f"{version}-0", "level": 0} for n in ("homes", "moves")}
    _write_part(_latest_places(rows), f"{root}/homes/part={version}-0", folders, order)
    own = _read_parts(spark, root, "homes", schema, [new["homes"]])
    earlier = _read_parts(spark, root, "homes", schema, _parts(entries, "homes"))
    seen = _latest_places(own.unionByName(earlier.join(own.select(*key).distinct(), key, "left_semi")))
    several = seen.groupBy(*key).agg(F.min("block_bucket").alias("lo"), F.max("block_bucket").alias("hi")).where("lo < hi").select(*key)
    _write_part(seen.join(several, key, "left_semi"), f"{root}/moves/part={version}-0", folders, order)
    touched = {tuple(r) for r in _read_parts(spark, root, "moves", schema, [new["moves"]]).select("kind", *FOLDER).distinct().collect()}
    parts = []
    for name in ("homes", "moves"):
        parts += _merged(spark, root, name, schema, [*_parts(entries, name), new[name]], version, _latest_places, folders, order)
    return touched, parts


def _current(spark: SparkSession, entity: Entity, changelog: DataFrame, folders: set[tuple[int, int]], root: str, moves: list[dict]) -> DataFrame:
    """The rows of some folders as a replay of the whole changelog would leave them."""
    rows = entity.rows(changelog.where((F.col("kind") == entity.kind) & _any_of(folders)))
    chains = sorted({c for c, _ in folders})
    markers = R.markers(changelog).where(F.col("chain_id").isin(chains))
    if entity.kind == S.LOG:
        return W.first_writer(R.invalidate(W.normalise_logs(rows), markers), S.LOG_KEY)
    if entity.kind == S.BLOCK:
        return R.invalidate(W.upsert_blocks(rows), markers)
    latest = W.upsert_transactions(rows) if entity.kind == S.TRANSACTION else W.upsert_receipts(rows)
    schema = _home(changelog)
    hidden = _read_parts(spark, root, "moves", schema, moves).where((F.col("kind") == entity.kind) & F.col("chain_id").isin(chains))
    later = hidden.groupBy(*S.TX_KEY).agg(F.max("seq").alias("_later"))
    # a hash in several buckets shows in the one of its last version only
    latest = latest.join(later, S.TX_KEY, "left").where(F.col("_later").isNull() | (F.col("_later") <= F.col("seq"))).select(*latest.columns)
    return R.invalidate(latest, markers)


def _write(spark: SparkSession, root: str, name: str, rows: DataFrame, version: int) -> set[tuple[int, int]]:
    """Write the rows of touched folders below a version's folder; returns the folders that hold some."""
    entity, path = ENTITIES[name], f"{root}/{name}/version={version}"
    order = ["block_number", entity.position]
    (
        rows.select(*entity.schema.fieldNames(), "block_bucket")
        .hint("rebalance", *FOLDER)
        .sortWithinPartitions(*FOLDER, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*FOLDER)
        .parquet(path)
    )
    return {(int(c), int(b)) for c, b in L.folders(spark, path, *FOLDER)}


def _index(spark: SparkSession, root: str, name: str, version: int, live: list[dict], parts: list[dict]) -> list[dict]:
    """Note which values the folders of a version hold. Merging leaves out what replaced folders held."""
    entity = ENTITIES[name]
    rows = table_of(spark, root, name, [{"version": version}])
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in entity.indexed]))
    rows = rows.select(*FOLDER, F.lit(version).cast("bigint").alias("made"), values.alias("x")).select("x.value", *FOLDER, "made", "x.field")
    folders, order = ("field",), ("value", *FOLDER)
    _write_part(rows.where("value is not null").distinct(), f"{root}/{name}_index/part={version}-0", folders, order)
    current = spark.createDataFrame([(e["chain"], e["bucket"], e["version"]) for e in live], "chain_id bigint, block_bucket bigint, made bigint")
    parts = [*parts, {"table": f"{name}_index", "part": f"{version}-0", "level": 0}]
    return _merged(spark, root, f"{name}_index", _INDEX, parts, version, lambda df: df.join(current, [*FOLDER, "made"], "left_semi"), folders, order)


def refresh(spark: SparkSession, changelog_path: str, batch_id: int, root: str, width: int = BLOCK_BUCKET, seq: T.DataType | None = None) -> None:
    """Bring the stored tables up to a stored batch. Running it again gives the same tables. For ``after_batch``.

    What passes the driver counts folders: those of the batch, of its moved hashes, and those that are live.
    """
    changelog = jobs.read_changelog(spark, changelog_path, seq or jobs.stored_seq(spark, changelog_path, batch_id))
    version, own = STEP * batch_id, F.col("batch_id") == batch_id
    _, entries = L.live(spark, root, before=version)
    touched = {tuple(r) for r in changelog.where(own & F.col("block_bucket").isNotNull()).select("kind", *FOLDER).distinct().collect()}
    moved, parts = _moved(spark, changelog, root, version, own, entries)
    lowest = {r[0]: r[1] // width for r in R.markers(changelog.where(own)).groupBy("chain_id").agg(F.min("from_block")).collect()}
    _apply(spark, changelog, root, version, entries, touched | moved, lowest, parts)


def rebuild(spark: SparkSession, changelog_path: str, root: str, chain_id: int, from_block: int, width: int = BLOCK_BUCKET, seq: T.DataType = T.LongType()) -> None:
    """Replay a chain from a block on: its folders from there are made anew from the changelog, whatever they hold now.

    Reads those buckets of the folded changelog and of its tail, nothing below. The tables get a version between two
    batches, so a stream goes on after it.
    """
    changelog = jobs.read_changelog(spark, changelog_path, seq)
    newest, entries = L.live(spark, root)
    if newest < 0:
        return
    first = from_block // width
    touched = {tuple(r) for r in changelog.where((F.col("chain_id") == chain_id) & (F.col("block_bucket") >= first)).select("kind", *FOLDER).distinct().collect()}
    _apply(spark, changelog, root, newest + 1, entries, touched, {chain_id: first}, _parts(entries, "homes") + _parts(entries, "moves"))


def _apply(spark: SparkSession, changelog: DataFrame, root: str, version: int, entries: list[dict], touched: set, lowest: dict[int, int], parts: list[dict]) -> None:
    moves = _parts(parts, "moves")

    def bring(name: str) -> list[dict]:
        entity, index = ENTITIES[name], _parts(entries, f"{name}_index")
        live = [e for e in entries if e["table"] == name]
        # a marker hides nothing below its block
        rewound = {(e["chain"], e["bucket"]) for e in live if e["chain"] in lowest and e["bucket"] >= lowest[e["chain"]]}
        folders = rewound | {(c, b) for k, c, b in touched if k == entity.kind}
        if folders:
            full = _write(spark, root, name, _current(spark, entity, changelog, folders, root, moves), version)
            live = [e for e in live if (e["chain"], e["bucket"]) not in folders]
            live += [{"table": name, "chain": c, "bucket": b, "version": version} for c, b in sorted(full)]
            if full and entity.indexed:
                index = _index(spark, root, name, version, live, index)
        return live + index

    # the tables do not depend on one another: their jobs share the cluster
    with ThreadPoolExecutor(len(ENTITIES)) as pool:
        made = [e for found in pool.map(bring, ENTITIES) for e in found]
    L.commit(spark, root, version, parts + made)


# --- reading ---------------------------------------------------------------------------------


def table_of(spark: SparkSession, root: str, name: str, entries: list[dict]) -> DataFrame:
    """The rows of some live folders, or of a whole version's; with their ``block_bucket``."""
    schema = T.StructType([*ENTITIES[name].schema.fields, T.StructField("block_bucket", T.LongType())])
    if not entries:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/{name}/version={e['version']}" + (f"/chain_id={e['chain']}/block_bucket={e['bucket']}" if "chain" in e else "") for e in entries]
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths).select(*schema.fieldNames())


def read(
    spark: SparkSession, root: str, name: str, chain_id: int | None = None, from_block: int | None = None, to_block: int | None = None,
    holding: str | None = None, fields: tuple[str, ...] | None = None, width: int = BLOCK_BUCKET,
) -> DataFrame:
    """A stored table, of which only folders that can matter are opened.

    Chain and block bounds choose folders by the manifest; ``holding``, an address or a hash, by the index over ``fields``
    (all indexed ones by default). Which rows of these folders match is left to the filters of the caller.
    """
    _, entries = L.live(spark, root)
    chosen = [
        e for e in entries if e["table"] == name and (chain_id is None or e["chain"] == chain_id)
        and (from_block is None or e["bucket"] >= from_block // width) and (to_block is None or e["bucket"] <= to_block // width)
    ]
    if holding is not None and ENTITIES[name].indexed:
        found = _read_parts(spark, root, f"{name}_index", _INDEX, _parts(entries, f"{name}_index"))
        found = found.where(F.col("field").isin(list(fields or ENTITIES[name].indexed)) & (F.col("value") == holding.lower()))
        # folders, not rows
        at = {tuple(r) for r in found.select(*FOLDER, "made").distinct().collect()}
        chosen = [e for e in chosen if (e["chain"], e["bucket"], e["version"]) in at]
    return table_of(spark, root, name, chosen)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete folders older than the live version that no kept version names; returns their number."""
    named = set()
    for v in L.versions(spark, root):
        for e in L.live(spark, root, before=v + 1)[1]:
            named.add((e["table"], f"part={e['part']}" if "part" in e else f"version={e['version']}"))
    newest, gone = L.live(spark, root)[0], 0
    for name in ["homes", "moves", *ENTITIES, *(f"{n}_index" for n in ENTITIES)]:
        for folder in L.names(spark, f"{root}/{name}"):
            made = folder.partition("=")[2].partition("-")[0]
            if made.isdigit() and int(made) < newest and (name, folder) not in named:
                L.delete(spark, f"{root}/{name}/{folder}")
                gone += 1
    return gone
