"""A trie of conversation prefixes, with only possibly shared prefixes moved.

A prefix of d turns is known by d and the sum, over its turns, of 128-bit hashes of turn and
place, so prefixes of one conversation are running sums. A count-min sketch of all prefixes
is screened first: it never counts too few, so an estimate of one proves that a prefix is in
one conversation only, and so are all longer ones. Such tails are given out where the
conversation is read; prefixes before them meet in an exact grouping. The sketch's width has
a bound; beyond it more prefixes take the exact way, none is lost.

A conversation is cut into pieces of ``PIECE`` turns, so none lies in one task whole however
long it is. What pieces hand on (hashes, sums) are a few numbers each.

A subtree's sums are sums over the conversations in it. Each node belongs to its smallest
member: a member adds the size of each of its nodes that is not its own, and a leaf if it
owns one. No level of the trie is walked, so the depth costs nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.llm import common

PIECE = 512
#: The sketch: rows, and the least and most cells of a row (a byte each while it is built).
ROWS, CELLS = 2, (1 << 16, 1 << 24)
CHUNK = 1 << 14
#: Conversations of one block of ids share the first turns of its first one, at most so many.
BLOCK, HEAD = 5, 8
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "x", "y"]


# ---- turns in order -------------------------------------------------------------

def ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """id, pos (from 0), size (UTF-8 bytes of the text), digest (of role and text) of every
    turn. Turns go by ``turn``, null first, equal ones by digest; repeated rows are turns of
    their own. A null role or text is empty; rows without a conversation are left out.

    Texts are not moved. Rows are sorted over all tasks and written with their places: a
    position is the conversation's rows in the parts before plus the place in its own part.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    raw = F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said).cast("binary")
    narrow = common.stage(conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("id"), F.col(turn).alias("turn"), F.octet_length(said[1]).cast("bigint").alias("size"), F.unhex(F.md5(raw)).alias("digest")), "turns")
    placed = common.stage(narrow.orderBy("id", F.asc_nulls_first("turn"), "digest").withColumns({
        "part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "places")
    parts = placed.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = W.partitionBy("id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return common.stage(placed.join(parts, ["id", "part"]).select("id", (F.col("place") + F.col("shift")).alias("pos"), "size", "digest"), "ordered")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) of conversations as they are: id, len, depth, size, digest; id, len."""
    convs = turns.groupBy("id").agg(F.count(F.lit(1)).alias("len"))
    return turns.join(convs, "id").select("id", "len", (F.col("pos") + 1).alias("depth"), "size", "digest"), convs


def headed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) as of ``plain``, each conversation c with its first h turns replaced by
    those of the first conversation of its block, as far as it has them; h = crc32(c) % 9."""
    h = F.crc32(F.col("id").cast("string").cast("binary")) % (HEAD + 1)
    counted = common.stage(turns.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h), "counted")
    bases = counted.select(F.col("id").alias("base"), F.col("n").alias("held"))
    convs = counted.withColumn("base", F.col("id") - F.col("id") % BLOCK).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("held", F.lit(0)))
    convs = common.stage(convs.select("id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "headed")
    own = turns.join(convs, "id").where("pos >= h").select("id", "len", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "size", "digest")
    heads = turns.where((F.col("id") % BLOCK == 0) & (F.col("pos") < HEAD)).withColumnRenamed("id", "base").join(convs, "base").where("pos < taken")
    return own.union(heads.select("id", "len", (F.col("pos") + 1).alias("depth"), "size", "digest")), convs.select("id", "len")


# ---- pieces and their prefixes ----------------------------------------------------

_PIECES = "id long, seg long, len long, sizes array<long>, x array<long>, y array<long>, sum_x long, sum_y long"


def _hashed(batches):
    """Pieces with the running sums of their turns' hashes."""
    for batch in batches:
        turns = batch.column("turns")
        at = np.append(0, np.cumsum(pa.compute.list_value_length(turns).to_numpy(zero_copy_only=False)))
        flat = turns.flatten()
        depth = flat.field("depth").to_numpy(zero_copy_only=False).astype(np.uint64)
        raw = np.frombuffer(b"".join(flat.field("digest").to_pylist()), np.uint64).reshape(-1, 2)
        sums, last = [], []
        for lane in (0, 1):
            h = common.mixed(raw[:, lane] + common.mixed(depth * np.uint64(0x9E3779B97F4A7C15) + np.uint64(lane + 1)))
            run = np.append(np.uint64(0), np.cumsum(h))
            last.append(pa.array(common.signed(run[at[1:]] - run[at[:-1]])))
            sums.append(common.lists(common.signed(run[1:] - np.repeat(run[at[:-1]], np.diff(at))), at, pa.int64()))
        sizes = common.lists(flat.field("size").to_numpy(zero_copy_only=False), at, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "seg", "len")), sizes, *sums, *last], names=["id", "seg", "len", "sizes", "x", "y", "sum_x", "sum_y"])


def _before(pieces: DataFrame, *names: str) -> list[Column]:
    """What the pieces before hand on: sums of 64-bit values that wrap around."""
    by = W.partitionBy("id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    out = []
    for name in names:
        low, high = (F.coalesce(F.sum(c).over(by), F.lit(0)) for c in (F.col(name).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(name, 32)))
        out.append(F.shiftleft((high + F.shiftrightunsigned(low, 32)).bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF)).alias(f"in_{name[-1]}"))
    return out


def _paths(rows: DataFrame, convs: DataFrame, piece: int) -> DataFrame:
    """One row per piece: id, seg, len, sizes, x, y (prefix hashes inside the piece), in_x,
    in_y (hash of what comes before). A conversation without turns has one empty piece."""
    turn = F.struct("depth", "size", "digest")
    cut = rows.groupBy("id", F.floor((F.col("depth") - 1) / piece).alias("seg")).agg(
        F.max("len").alias("len"), F.array_sort(F.collect_list(turn)).alias("turns"))
    none = convs.where("len = 0").select("id", F.lit(0).cast("bigint").alias("seg"), "len", F.array().cast(cut.schema["turns"].dataType).alias("turns"))
    pieces = common.stage(cut.union(none).mapInArrow(_hashed, _PIECES), "pieces")
    long = pieces.where(F.col("len") > piece)
    handed = long.select("id", "seg", "sum_x", "sum_y").select("id", "seg", *_before(long, "sum_x", "sum_y"))
    zero = F.lit(0).cast("bigint")
    names = ["id", "seg", "len", "sizes", "x", "y", "in_x", "in_y"]
    return pieces.where(F.col("len") <= piece).withColumns({"in_x": zero, "in_y": zero}).select(*names).union(long.join(handed, ["id", "seg"]).select(*names))


def _flat(batch: pa.RecordBatch):
    """(at, sizes, x, y) of a batch of paths, hashes from the start of the conversation."""
    at = np.append(0, np.cumsum(pa.compute.list_value_length(batch.column("sizes")).to_numpy(zero_copy_only=False)))
    n = np.diff(at)
    xy = [batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64) + np.repeat(batch.column(f"in_{c}").to_numpy().view(np.uint64), n) for c in "xy"]
    return at, batch.column("sizes").flatten().to_numpy(zero_copy_only=False), *xy


def _cells(x: np.ndarray, y: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(common.mixed(x + y * np.uint64(2 * j + 3)) & np.uint64(cells - 1)).astype(np.int64) for j in range(ROWS)]


def sketch(paths: DataFrame, cells: int) -> np.ndarray:
    """The count-min sketch as bits: which cells of each row count two prefixes or more. Each
    task gives out the parts of its sketch that are not empty; the parts are added up where
    they meet, one at a time, and stop at two."""

    def build(batches):
        table = np.zeros((ROWS, cells), np.uint8)
        for batch in batches:
            _, _, x, y = _flat(batch)
            for row, cell in zip(table, _cells(x, y, cells)):
                at, n = np.unique(cell, return_counts=True)
                row[at] = np.minimum(row[at] + n, 2)
        parts = table.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        for i in range(0, len(used), 256):
            some = used[i:i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[j].tobytes() for j in some], pa.binary())], names=["part", "counts"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts")):
                own = held.setdefault(part, np.zeros(CHUNK, np.uint8))
                np.minimum(own + np.frombuffer(raw.as_buffer(), np.uint8), 2, out=own)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(v == 2).tobytes() for v in held.values()], pa.binary())], names=["part", "twice"])

    parts = paths.select("sizes", "x", "y", "in_x", "in_y").mapInArrow(build, "part long, counts binary").repartition("part")
    out = np.zeros(ROWS * cells // 8, np.uint8).reshape(-1, CHUNK // 8)
    for batch in parts.mapInArrow(merge, "part long, twice binary").toArrow().to_batches():
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("twice").to_pylist()):
            out[part] = np.frombuffer(raw, np.uint8)
    return out.reshape(ROWS, cells // 8)


_SCREENED = ("id long, seg long, len long, start long, n long, k long, bx long, by long, "
             "shared array<struct<depth: long, size: long, x: long, y: long, px: long, py: long>>")


def _screened(paths: DataFrame, twice: np.ndarray, cells: int, piece: int) -> DataFrame:
    """Pieces after the screening: their first ``k`` prefixes may be shared and are in
    ``shared`` with their parents; the rest are in this conversation only, and hang on the
    prefix (start + k, bx, by)."""
    sent = paths.sparkSession.sparkContext.broadcast(twice)

    def run(batches):
        for batch in batches:
            at, sizes, x, y = _flat(batch)
            n = np.diff(at)
            may = np.ones(len(x), bool)
            for bits, cell in zip(sent.value, _cells(x, y, cells)):
                may &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            proved = np.append(np.flatnonzero(~may), len(x))
            k = np.minimum(proved[np.searchsorted(proved, at[:-1])], at[1:]) - at[:-1]
            start = batch.column("seg").to_numpy() * piece
            inner = np.arange(len(x)) - np.repeat(at[:-1], n)
            parent = []
            for own, name in ((x, "in_x"), (y, "in_y")):
                handed = batch.column(name).to_numpy().view(np.uint64)
                before = np.append(np.uint64(0), own)[:len(own)]
                parent.append((np.where(inner == 0, np.repeat(handed, n), before), handed))
            keep = inner < np.repeat(k, n)
            tail = np.minimum(at[:-1] + k, max(len(x) - 1, 0))
            hang = [common.signed(np.where(k == 0, handed, np.append(before, np.uint64(0))[tail] if len(x) else handed)) for before, handed in parent]
            fields = [np.repeat(start, n) + inner + 1, sizes, common.signed(x), common.signed(y), common.signed(parent[0][0]), common.signed(parent[1][0])]
            struct = pa.StructArray.from_arrays([pa.array(v[keep], pa.int64()) for v in fields], names=["depth", "size", "x", "y", "px", "py"])
            shared = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)).astype(np.int32)), struct)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "seg", "len")), *(pa.array(v, pa.int64()) for v in (start, n, k, *hang)), shared],
                                             names=["id", "seg", "len", "start", "n", "k", "bx", "by", "shared"])

    return common.stage(paths.mapInArrow(run, _SCREENED), "screened")


# ---- members' lists ---------------------------------------------------------------

def _digests(ends: DataFrame) -> DataFrame:
    """depth, x, y, sha: SHA-256 of each node's ids (column id) in order, comma-joined. Ids
    are sorted over all tasks and joined to blocks of text there; only a node's blocks, in
    order, pass through one task, which holds one batch of them at a time."""

    def join(batches):
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in NODE])
            ids = batch.column("id").to_pylist()
            cut = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), len(ids)) if ids else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v[cut[:-1]], pa.int64()) for v in keys), pa.array([ids[i] for i in cut[:-1]], pa.int64()),
                 pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cut, cut[1:])], pa.string())], names=[*NODE, "first", "ids"])

    def digest(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "first", "ids"))):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield _shas(out)
        yield _shas([(*node, state.hexdigest())] if node is not None else [])

    blocks = ends.select(*NODE, "id").orderBy(*NODE, "id").mapInArrow(join, "depth long, x long, y long, first long, ids string")
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, x long, y long, sha string")


def _shas(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[*NODE, "sha"])


# ---- the trie -----------------------------------------------------------------------

def _values(batches):
    """Per shared prefix of a conversation: the sizes from it on that others own, and whether
    the conversation owns a leaf."""
    for batch in batches:
        shared = batch.column("shared")
        at = np.append(0, np.cumsum(pa.compute.list_value_length(shared).to_numpy(zero_copy_only=False)))
        flat, n = shared.flatten(), np.diff(at)
        depth, size, x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("depth", "size", "x", "y"))
        foreign = np.append(0, np.cumsum(np.where(depth < np.repeat(batch.column("own").to_numpy(), n), size, 0)))
        value = np.repeat(foreign[at[1:]] + batch.column("later").to_numpy(), n) - foreign[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (depth, x, y, value, np.repeat(batch.column("leaf").to_numpy(), n))], names=[*NODE, "value", "leaf"])


def trie(rows: DataFrame, convs: DataFrame, cells: int | None = None, piece: int = PIECE) -> DataFrame:
    """The nodes of the trie of conversations ``rows`` (id, len, depth, size, digest) with
    ``convs`` (id, len): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. A node's last turn is the depth-th turn
    of its ``conv_id``. Without conversations there is no node, not even the root.

    ``cells`` is the sketch's width, a power of two; by itself it is four times the number
    of turns, within ``CELLS``. Neither it nor ``piece`` changes a result.
    """
    paths = _paths(rows, convs, piece)
    if cells is None:
        turns = paths.agg(F.sum(F.size("sizes"))).first()[0] or 0
        cells = min(max(CELLS[0], 1 << (4 * turns).bit_length()), CELLS[1])
    found = _screened(paths, sketch(paths, cells), cells, piece)
    zero = F.lit(0).cast("bigint")
    null = F.lit(None).cast("bigint")
    shared = found.select("id", "len", F.inline("shared")).union(
        found.where("seg = 0").select("id", "len", zero, zero, zero, zero, null, null))
    end = F.col("depth") == F.col("len")
    groups = common.stage(shared.groupBy(*NODE).agg(
        F.min("id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("px").alias("px"), F.max("py").alias("py"),
        F.count_if(end).alias("ends"), F.max(F.when(end, F.col("id"))).alias("one")), "groups")
    hang = found.where("k < n").select("id", "len", (F.col("start") + F.col("k")).alias("depth"), F.col("bx").alias("x"), F.col("by").alias("y"))
    kids = groups.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    kids = kids.union(hang.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))).groupBy(*NODE).agg(F.sum("n").alias("n_children"))
    above = groups.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("up"))
    nodes = common.stage(
        groups.join(kids, NODE, "left").join(above, ["depth", "px", "py"], "left")
        .select(*NODE, "conv_id", "n_convs", "ends", "one", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id")), "nodes")

    # What each conversation owns: its nodes from the depth ``own`` on, and perhaps a leaf.
    owners = nodes.select(F.col("conv_id").alias("id"), F.col("depth").alias("own"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    alone = found.where((F.col("k") < F.col("n")) & (F.col("len") > piece)).select("id", null.alias("own"), F.lit(1).cast("bigint").alias("leaf"))
    owned = owners.union(alone).groupBy("id").agg(F.min("own").alias("own"), F.max("leaf").alias("leaf"))
    tail = (F.col("k") < F.col("n")).cast("bigint")
    told = found.join(owned, "id", "left").select(
        "id", "seg", "len", "shared", F.coalesce("own", F.lit((1 << 62))).alias("own"), F.greatest(F.coalesce("leaf", zero), tail).alias("leaf"))
    foreign = F.aggregate(F.filter("shared", lambda s: s["depth"] < F.col("own")), zero, lambda acc, s: acc + s["size"])
    after = W.partitionBy("id").orderBy(F.desc("seg")).rowsBetween(W.unboundedPreceding, -1)
    long = told.where(F.col("len") > piece)
    later = long.select("id", "seg", foreign.alias("u")).select("id", "seg", F.coalesce(F.sum("u").over(after), zero).alias("later"))
    root = F.when(F.col("seg") == 0, F.array(F.struct(*[zero.alias(c) for c in ("depth", "size", "x", "y", "px", "py")]))).otherwise(F.array().cast(found.schema["shared"].dataType))
    told = told.where(F.col("len") <= piece).withColumn("later", zero).union(long.join(later, ["id", "seg"]).select(*told.columns, "later"))
    sums = told.select("own", "leaf", "later", F.concat(root, "shared").alias("shared")).mapInArrow(
        _values, "depth long, x long, y long, value long, leaf long").groupBy(*NODE).agg(F.sum("value").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    shas = _digests(shared.where(end))
    own_id = F.sha2(F.col("one").cast("string").cast("binary"), 256)
    exact = nodes.join(sums, NODE).join(shas, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.when(F.col("ends") == 0, F.lit(NOTHING)).when(F.col("ends") == 1, own_id).otherwise(F.col("sha")).alias("ends_sha256"))

    def single(id_: str, depth: Column, parent: Column) -> list[Column]:
        last = depth == F.col("len")
        one = F.lit(1).cast("bigint")
        sha = F.when(last, F.sha2(F.col(id_).cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING))
        return [F.col(id_).alias("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"),
                one.alias("n_leaves"), zero.alias("saved_tokens"), sha.alias("ends_sha256")]

    tails = found.where("k + 1 < n").select("id", "len", F.explode(F.sequence(F.col("start") + F.col("k") + 2, F.col("start") + F.col("n"))).alias("depth"))
    up = groups.select(*NODE, F.col("conv_id").alias("up"))
    first = hang.join(up, NODE, "left")
    return exact.union(tails.select(*single("id", F.col("depth"), F.col("id")))).union(first.select(*single("id", F.col("depth") + 1, F.coalesce("up", "id"))))


def nodes(conversations: DataFrame, **names: str) -> DataFrame:
    """The trie of conversations as they are; ``names`` as for ``ordered``. Only the columns
    named are read."""
    return trie(*plain(ordered(conversations, **names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*headed(ordered(common.table(spark, sf_dir, "conversations"))))
