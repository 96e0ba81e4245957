"""Sharding by histogram sort, in DataFrame operations alone.

The sort key of a row is the 64-bit hash of its text, so equal texts lie together. Each round counts
the exact bytes below candidate boundaries, as sums over the cells of a grid on the key space; only the
cells that hold a splitter are refined in the next round, until every splitter meets the tolerance or
its cell holds one key. Groups of equal texts that are heavier than the tolerance are placed first, the
heaviest to the lightest shard; the splitters then fill the shards up. Rows move in one exchange.

Law ``bytes``: sizes of shards near equal. A group of equal texts stays in one shard, unless it alone
is larger than a shard; such a group is dealt out by id in parts.

Defined results: a null text counts as empty (size 1, checksum 0); rows with a null id are one part;
repeated rows each get a slot; texts that tie keep together; an empty table gives no rows; other columns pass
through, those called like new ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import free_name, materialise, text_size

#: Bits of the key that one round of probes resolves.
ROUND_BITS = 8
#: Part of a shard's bytes by which a splitter may miss.
TOLERANCE = 0.002
#: Buckets of a shard within which rows are numbered, at least, and the bytes of text in one.
SUB_BUCKETS = 64
BUCKET_BYTES = 256 << 20
COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _cell(bits: int) -> Column:
    """Grid cell of the key at a resolution, in the order of signed keys."""
    return F.shiftright(F.col("_key"), 64 - bits)


def find_splitters(keys: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """Boundaries b so that the bytes of keys below b miss each target by ``tolerance`` at most, where keys allow it.

    ``keys`` has ``_key`` and ``_size``. A round sends one sum a cell to the driver: 2^8 for each open splitter.
    """
    done: dict[int, int] = {}
    open_cells: dict[int, tuple[int, float]] = {i: (0, 0.0) for i in range(len(targets))}  # splitter: cell, bytes below it
    bits = 0
    while open_cells:
        rows = keys
        if bits:
            rows = rows.filter(_cell(bits).isin(sorted({c for c, _ in open_cells.values()})))
        bits += ROUND_BITS
        got = rows.groupBy(_cell(bits).alias("cell")).agg(F.sum("_size").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect()
        cells = sorted((r["cell"], r["n"], r["lo"], r["hi"]) for r in got)
        for i, (cell, below) in list(open_cells.items()):
            inside = [c for c in cells if bits == ROUND_BITS or c[0] >> ROUND_BITS == cell]
            best = None
            for at, n, lo, hi in inside:
                if below + n >= targets[i] or at == inside[-1][0]:
                    best = (at, n, lo, hi)
                    break
                below += n
            if best is None:
                done[i] = (1 << 63) - 1
                del open_cells[i]
                continue
            at, n, lo, hi = best
            before, after = targets[i] - below, below + n - targets[i]
            if before <= tolerance or lo == hi and before <= after:
                done[i] = lo
                del open_cells[i]
            elif abs(after) <= tolerance or lo == hi or bits >= 64:
                done[i] = min(hi + 1, (1 << 63) - 1)
                del open_cells[i]
            else:
                open_cells[i] = (at, below)
    return [done[i] for i in range(len(targets))]


def plan_shards(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], dict[tuple[int, int], int], dict[int, int]]:
    """Splitters, the shard of each (heavy key, part), and the parts of each heavy key.

    Heavy keys number at most shards / tolerance, so their list is bounded whatever the input.
    """
    total = keys.agg(F.sum("_size").alias("n")).first()["n"] or 0
    per_shard = total / shards
    heavy = keys.groupBy("_key").agg(F.sum("_size").alias("n"), F.count("*").alias("rows")).filter((F.col("n") > per_shard * tolerance) & (F.col("rows") > 1))
    parts: dict[int, int] = {}
    items = []
    for row in heavy.collect():
        k = 1 if row["n"] <= per_shard else 8 * -(-row["n"] // max(1, int(per_shard)))
        parts[row["_key"]] = k
        items += [(row["n"] / k, row["_key"], part) for part in range(k)]
    load, placed = [0.0] * shards, {}
    for n, key, part in sorted(items, reverse=True):
        lightest = min(range(shards), key=lambda s: (load[s], s))
        placed[(key, part)] = lightest
        load[lightest] += n
    light = total - sum(load)
    level = _fill(load, light)
    targets, below = [], 0.0
    for s in range(shards - 1):
        below += max(0.0, level - load[s])
        targets.append(below)
    rest = keys.filter(~F.col("_key").isin(list(parts))) if parts else keys
    splitters = find_splitters(rest, targets, per_shard * tolerance) if light else [(1 << 63) - 1] * (shards - 1)
    return splitters, placed, parts


def _fill(load: list[float], rest: float) -> float:
    """The level to which ``rest`` fills up shards that already hold ``load``."""
    ordered = sorted(load)
    for i in range(1, len(ordered) + 1):
        level = (rest + sum(ordered[:i])) / i
        if i == len(ordered) or level <= ordered[i]:
            return level
    return 0.0


def assign(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    Where ``docs`` has columns of these names they stay, and the new ones get an underscore behind theirs.
    """
    rows = _keyed(docs, text, doc_id)
    keys = materialise(rows.drop("row"), "shard-keys")
    found = _dealt(rows, keys, shards, tolerance)
    new = [F.col(f"new.{c}").alias(free_name(c, docs.columns)) for c in COLUMNS]
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns), *new)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Id, size, checksum and sort key of each row, and the row itself."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("_id"), (text_size(text) + 1).alias("_size"), F.crc32(body).cast("long").alias("_crc"), F.xxhash64(body).alias("_key"))


def _dealt(rows: DataFrame, keys: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """``rows`` with the struct ``new`` of the columns of the law.

    Slots are gapless from 0 in each shard: bucket counts give offsets, and rows are numbered within their
    bucket, so no task sorts a whole shard. Buckets are so many that each holds BUCKET_BYTES about.
    """
    spark = rows.sparkSession
    splitters, placed, parts = plan_shards(keys, shards, tolerance)
    total = keys.agg(F.sum("_size").alias("n")).first()["n"] or 0
    buckets = max(SUB_BUCKETS, -(-total // (BUCKET_BYTES * shards)))
    heavy = F.broadcast(spark.createDataFrame([(k, p, s, parts[k]) for (k, p), s in placed.items()], "_key long, _part int, _heavy int, _parts int"))

    def sharded(frame: DataFrame) -> DataFrame:
        light = sum((F.col("_key") >= F.lit(b)).cast("int") for b in splitters) if splitters else F.lit(0)
        if placed:
            counts = F.broadcast(spark.createDataFrame(list(parts.items()), "_key long, _parts int"))
            frame = frame.join(counts, "_key", "left").withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), F.col("_id")), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
            frame = frame.join(heavy.drop("_parts"), ["_key", "_part"], "left").withColumn("_shard", F.coalesce("_heavy", light)).drop("_heavy", "_part")
        else:
            frame = frame.withColumn("_shard", light)
        return frame.withColumn("_sub", F.pmod(F.xxhash64(F.lit("sub"), F.col("_id"), F.when(F.col("_id").isNull(), F.col("_key"))), F.lit(buckets)).cast("int"))

    totals = sharded(keys).groupBy("_shard", "_sub").agg(F.count("*").alias("n")).collect()  # shards x buckets rows
    offsets, last = [], {}
    for r in sorted(totals, key=lambda r: (r["_shard"], r["_sub"])):
        offsets.append((r["_shard"], r["_sub"], last.get(r["_shard"], 0)))
        last[r["_shard"]] = last.get(r["_shard"], 0) + r["n"]
    offset = F.broadcast(spark.createDataFrame(offsets, "_shard int, _sub int, _offset long"))
    within = Window.partitionBy("_shard", "_sub").orderBy("_key", "_id")
    new = {"size": F.col("_size"), "text_crc32": F.col("_crc"), "law": F.lit("bytes"), "shard": F.col("_shard").cast("int"), "slot": (F.coalesce("_offset", F.lit(0)) + F.col("_row") - 1).cast("long"), "grown_shard": F.lit(None).cast("int")}
    return sharded(rows).withColumn("_row", F.row_number().over(within)).join(offset, ["_shard", "_sub"], "left").withColumn("new", F.struct(*(new[c].alias(c) for c in COLUMNS)))


def digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The columns of the contract; the text is read once and no text moves."""
    keys = materialise(_keyed(docs.select("doc_id", "text"), "text", "doc_id").drop("row"), "shard-keys")
    return _dealt(keys, keys, shards, TOLERANCE).select(F.col("_id").alias("doc_id"), "new.*")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write the rows to one folder a shard (``shard=0`` and so on), rows in slot order."""
    assign(docs, shards).repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
