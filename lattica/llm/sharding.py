"""Sharding by fixed virtual slots (DataFrame functions only).

Records hash into thousands of slots, bytes are summed per slot, and a slot-to-shard map is stored as a table with a
version. A record's slot never changes, so rebalancing edits the map and moves whole slots. The law is ``bytes``: the
sizes of the shards are near equal.

A stored map is a folder with a folder per version, which holds the map (home, shard) and the heavy texts whose rows
have slots of their own. Later versions keep the heavy texts of the earlier ones and number new ones after them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.shared import is_empty, scratch_dir, shared_table

SLOTS = 4096
#: A text is heavy if its copies fill more than an equal share of a shard, or than the second of these parts of one
#: where the shards can't be near equal otherwise; it is then spread over slots that hold about a 64th of a share each.
HEAVY_PARTS = (1.0, 1 / 16)
SLOTS_PER_SHARE = 64
#: How far a shard may be from an equal share before a stored map is edited.
TOLERANCE = 0.02


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text has none), text_crc32, text_hash, id_hash, seq and ``more``.

    ``seq`` tells rows apart that repeat an id and a text; it is fixed once the table is written.
    """
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(id_col).alias("id_hash"),
        F.monotonically_increasing_id().alias("seq"),
        *more,
    )


HEAVY = "text_hash long, first long, width long"
#: (text_hash, id_hash) of ids that repeat a heavy text so often that they would overfill a slot of theirs.
REPEATED = "text_hash long, id_hash long"
MAP = "home long, shard int"


def heavy_texts(
    sized: DataFrame, n_shards: int, known: DataFrame | None = None, part: float = HEAVY_PARTS[0]
) -> DataFrame:
    """HEAVY rows: the texts whose copies exceed ``part`` of a share, and the slots from ``first`` that are theirs.

    They are fewer than ``n_shards / part`` whatever the input. ``known``, of an earlier version, stays as it is.
    """
    slot = F.pmod("text_hash", F.lit(SLOTS))
    bytes_by_slot = sized.groupBy(slot.alias("home")).agg(F.sum("size").alias("bytes"))
    share = F.sum("bytes").over(Window.partitionBy()) / n_shards  # a row per slot
    full = bytes_by_slot.withColumn("share", share).filter(F.col("bytes") > F.col("share") * part)
    texts = sized.select(slot.alias("home"), "text_hash", "size").join(F.broadcast(full.select("home", "share")), "home")
    texts = texts.groupBy("text_hash", "share").agg(F.sum("size").alias("bytes"))
    texts = texts.filter(F.col("bytes") > F.col("share") * part)
    if known is not None:
        texts = texts.join(F.broadcast(known.select("text_hash")), "text_hash", "left_anti")
    width = F.ceil(F.col("bytes") / F.col("share") * SLOTS_PER_SHARE).cast("long")
    texts = texts.select("text_hash", width.alias("width"))
    before = Window.orderBy("text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(SLOTS).cast("long") if known is None else F.lit(
        known.agg(F.coalesce(F.max(F.col("first") + F.col("width")), F.lit(SLOTS))).first()[0]
    ).cast("long")
    first = start + F.coalesce(F.sum("width").over(before), F.lit(0))
    fresh = texts.select("text_hash", first.alias("first"), "width")
    return fresh if known is None else known.unionByName(fresh)


def repeated_ids(sized: DataFrame, heavy: DataFrame) -> DataFrame:
    """REPEATED rows: ids that hold over half of a slot's part of a heavy text, so fewer than twice its slots."""
    rows = sized.join(F.broadcast(heavy), "text_hash")
    totals = rows.groupBy("text_hash", "id_hash", "width").agg(F.count("*").alias("n"))
    of_text = rows.groupBy("text_hash").agg(F.count("*").alias("all"))
    totals = totals.filter("n > 1").join(F.broadcast(of_text), "text_hash")
    return totals.filter(F.col("n") * F.col("width") * 2 > F.col("all")).select("text_hash", "id_hash")


def with_slots(rows: DataFrame, heavy: DataFrame, repeated: DataFrame) -> DataFrame:
    """Add ``home``, the virtual slot, to rows with text_hash, id_hash and seq.

    Equal texts share a slot unless they are heavy; then ids spread them, and repeated ids their rows. ``heavy`` and
    ``repeated`` have a few thousand rows at most whatever the input, so they are broadcast.
    """
    marked = rows.join(F.broadcast(heavy), "text_hash", "left")
    own = F.col("id_hash")
    if not is_empty(repeated):
        often = F.broadcast(repeated.withColumn("often", F.lit(True)))
        marked = marked.join(often, ["text_hash", "id_hash"], "left")
        own = F.when(F.col("often"), F.xxhash64("seq")).otherwise(own)
    spread = F.col("first") + F.pmod(F.xxhash64(own), F.col("width"))
    home = F.coalesce(spread, F.pmod("text_hash", F.lit(SLOTS))).cast("long")
    return marked.withColumn("home", home).drop("first", "width", "often")


def on_shards(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``shard`` to rows with ``home``. A slot that the map doesn't have is an error, as its rows would be lost."""
    placed = rows.join(F.broadcast(slot_map.select("home", "shard")), "home", "left")
    missing = F.raise_error(F.concat(F.lit("no shard for virtual slot "), F.col("home").cast("string"))).cast("int")
    return placed.withColumn("shard", F.coalesce("shard", missing))


def _packed(loads: Column, slots: Column) -> Column:
    """Give each slot of an array (largest first) to the shard with the fewest bytes so far: the shards' numbers."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def give(state: Column, slot: Column) -> Column:
        shard = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        grown = F.transform(state["loads"], lambda x, i: F.when(i == shard, x + slot["bytes"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["shards"], F.array(shard)).alias("shards"))

    return F.aggregate(slots, start, give, lambda state: state["shards"])


def _assigned(slot_bytes: DataFrame, loads: Column) -> DataFrame:
    """(home, shard) for the slots of ``slot_bytes``, of which there are a few thousand at most."""
    largest_first = F.sort_array(F.collect_list(F.struct("bytes", "home")), asc=False)
    packed = slot_bytes.agg(largest_first.alias("slots")).filter(F.size("slots") > 0)
    pairs = F.arrays_zip(F.col("slots.home").alias("home"), _packed(loads, F.col("slots")).alias("shard"))
    rows = packed.select(F.explode(pairs).alias("pair"))
    return rows.select(F.col("pair.home").alias("home"), F.col("pair.shard").alias("shard"))


def new_map(slot_bytes: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: version, home, shard. Slots go, largest first, to the shard with the fewest bytes."""
    empty = F.array_repeat(F.lit(0).cast("long"), n_shards)
    return _assigned(slot_bytes, empty).select(F.lit(1).alias("version"), "home", "shard")


def edited_map(old: DataFrame, slot_bytes: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The next version of ``old`` for the present ``slot_bytes`` and number of shards.

    A shard keeps its largest slots while they fit into an equal share plus ``tolerance``; the other slots, those of
    shards that no longer exist and new ones are given out again. Untouched slots stay, so few records move.
    """
    share = F.sum("bytes").over(Window.partitionBy()) / n_shards
    here = slot_bytes.join(old.select("version", "home", "shard"), "home", "left").withColumn("share", share)
    version = F.coalesce(F.max("version").over(Window.partitionBy()), F.lit(0)) + 1
    running = Window.partitionBy("shard").orderBy(F.desc("bytes"), "home").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("bytes").over(running)
    stays = F.coalesce((F.col("shard") < n_shards) & (upto <= F.col("share") * (1 + tolerance)), F.lit(False))
    here = here.withColumns({"version": version, "stays": stays})
    here = shared_table(here, "shard-edit")
    kept = here.filter("stays")
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    loads = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("loads"))
    row = loads.first()["loads"]  # one number per shard
    start = F.array(*[F.lit(int(row.get(k, 0))).cast("long") for k in range(n_shards)])
    moved = _assigned(here.filter("NOT stays"), start)
    fresh = moved.join(here.select("home", "version"), "home").select("version", "home", "shard")
    return kept.select("version", "home", "shard").unionByName(fresh)


def stored_version(spark: SparkSession, folder: str) -> int:
    """The newest version of the map in ``folder``; 0 if it holds none."""
    try:
        newest = spark.read.parquet(f"{folder}/map").agg(F.max("version")).first()[0]
    except AnalysisException:  # no such folder yet
        return 0
    return newest or 0


def _table(spark: SparkSession, folder: str, name: str, version: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}/version={version}")


def _stored(df: DataFrame, folder: str, name: str, version: int, schema: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/version={version}")
    return _table(df.sparkSession, folder, name, version, schema)


def load_map(spark: SparkSession, folder: str, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The map (home, shard), heavy texts and repeated ids of one version."""
    kinds = (("map", MAP), ("heavy", HEAVY), ("repeated", REPEATED))
    return tuple(_table(spark, folder, name, version, schema) for name, schema in kinds)


def current_map(
    sized: DataFrame, n_shards: int, folder: str, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The map in ``folder`` for the rows of ``sized``: loaded, edited if they need it, and stored as a new version.

    It is edited if slots are missing in it, if it names other shards than there are, or if a shard's bytes are more
    than ``tolerance`` above an equal share. Without a stored map the first version is made. The map of a version is
    written last, so a version without one was broken off and is written again.
    """
    spark = sized.sparkSession
    version = stored_version(spark, folder)
    if not version:
        return _first_map(sized, n_shards, folder, tolerance)
    known = load_map(spark, folder, version)
    heavy, repeated, slot_bytes = _slots(sized, n_shards, folder, version + 1, known, HEAVY_PARTS[0])
    old = known[0].withColumn("version", F.lit(version))
    loads = _loads(slot_bytes, old)
    share = sum(loads.values()) / n_shards
    unplaced = any(shard is None or shard >= n_shards for shard in loads)
    empty = len(loads) < min(n_shards, slot_bytes.count())
    if unplaced or empty or any(size > share * (1 + tolerance) for size in loads.values()):
        # slots without rows now keep their shard
        idle = old.join(slot_bytes, "home", "left_anti").filter(F.col("shard") < n_shards)
        fresh = edited_map(old, slot_bytes, n_shards, tolerance).select("home", "shard")
        fresh = fresh.unionByName(idle.select("home", "shard"))
        return _stored(fresh, folder, "map", version + 1, MAP), heavy, repeated
    return known[0], heavy, repeated


def _slots(
    sized: DataFrame, n_shards: int, folder: str, version: int, known: tuple | None, part: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The heavy texts and repeated ids of a version, stored, and the bytes of its slots."""
    heavy = heavy_texts(sized, n_shards, known[1] if known else None, part)
    heavy = _stored(heavy, folder, "heavy", version, HEAVY)
    repeated = sized.sparkSession.createDataFrame([], REPEATED) if is_empty(heavy) else repeated_ids(sized, heavy)
    if known:
        repeated = known[2].unionByName(repeated).distinct()
    repeated = _stored(repeated, folder, "repeated", version, REPEATED)
    slot_bytes = with_slots(sized, heavy, repeated).groupBy("home").agg(F.sum("size").alias("bytes"))
    return heavy, repeated, shared_table(slot_bytes, "shard-bytes")


def _loads(slot_bytes: DataFrame, slot_map: DataFrame) -> dict[int | None, int]:
    """The bytes of each shard; None for slots that the map doesn't have."""
    rows = slot_bytes.join(slot_map, "home", "left").groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()
    return {row["shard"]: row["bytes"] for row in rows}


def _first_map(sized: DataFrame, n_shards: int, folder: str, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Version 1: copies of a text stay together unless the shards can't be near equal then."""
    for part in HEAVY_PARTS:
        heavy, repeated, slot_bytes = _slots(sized, n_shards, folder, 1, None, part)
        fresh = shared_table(new_map(slot_bytes, n_shards).select("home", "shard"), "shard-map")
        loads = _loads(slot_bytes, fresh)
        if max(loads.values(), default=0) * n_shards <= sum(loads.values()) * (1 + tolerance):
            break
    return _stored(fresh, folder, "map", 1, MAP), heavy, repeated


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/shard-map-{uuid.uuid4().hex}"


def shards(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    map_folder: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, home.

    ``slot`` is the place in the shard, gapless from 0; ``home`` the virtual slot, by which the map goes. Copies of a
    text share a shard unless they exceed an equal share, or a 16th of one where the shards can't be near equal
    otherwise; such a text is spread over slots of its own by id, and the rows of an id that repeats it very often by
    themselves. ``grown_shard`` is null: under the law ``bytes``
    the map decides, not the id.

    With ``map_folder`` the newest map stored there is used, and edited and stored as the next version where the rows
    need it, so few of them move; without, a map of its own is stored in the scratch folder.

    Null text has size 1, no checksum and one hash of its own; null ids are an id like any other. Repeated rows each
    get a place. A text of any length is one record of its size. Places follow the order of reading, so another run may
    number a shard's rows in another order. An empty table gives no rows. Other columns are ignored, whatever their
    names.
    """
    sized = shared_table(measured(docs, id_col, text_col), "shard-sizes")
    slot_map, heavy, repeated = current_map(sized, n_shards, map_folder or _own_folder(docs.sparkSession))
    placed = on_shards(with_slots(sized, heavy, repeated), slot_map)

    # seq begins with the number of the task that wrote the row: a bounded group to number rows in
    placed = placed.withColumn("task", F.shiftright("seq", 33))
    counted = placed.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "task").orderBy("seq")
    placed = placed.withColumn("row", F.row_number().over(inside)).join(starts, ["shard", "task"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "home",
    )


def sharded_documents(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    map_folder: str | None = None,
) -> DataFrame:
    """``docs`` with the columns ``home`` and ``shard`` (which replace columns of these names).

    The map has a few thousand rows, so it is broadcast and the texts don't shuffle. ``map_folder``, nulls, repeated
    rows, long texts and empty tables are treated as in :func:`shards`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("home", "shard")])
    # written with the number that tells equal rows apart: another plan of ``docs`` could number them in another way
    sized = shared_table(measured(docs, id_col, text_col, row.alias("row")), "shard-rows")
    slot_map, heavy, repeated = current_map(sized.drop("row"), n_shards, map_folder or _own_folder(docs.sparkSession))
    placed = with_slots(sized.select("row", "id_hash", "text_hash", "seq"), heavy, repeated)
    return on_shards(placed, slot_map).select("row.*", "home", F.col("shard").cast("int").alias("shard"))
