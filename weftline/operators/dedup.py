"""Exact and embedding-based near duplicates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import fingerprint

#: Vectors of a block (of a matrix product, at most), and pivots that cells are made of, at most.
BLOCK, PIVOTS = 2048, 256
#: Blocks that a cell is cut into, at most, unless a block would have more than this many bytes of vectors.
GRID, BLOCK_BYTES = 16, 64 << 20
#: Vectors that a round of the greedy scan settles at first hand, by count and bytes; rounds go on while one settles this share of what is open.
LOOK, LOOK_BYTES, YIELD = 16_384, 8 << 20, 0.125


def exact_dup(rows: DataFrame, text: str, order: Sequence[str], key: str = "id") -> DataFrame:
    """Rows whose normalised text was seen before, with the first such row.

    The first row of a group is the least by ``order`` (the last of which should be unique). The
    group's first is a minimum, so Spark folds it before the shuffle and a group of any size
    costs one row a task; a window would gather the whole group in one task.
    """
    narrow = rows.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in order], F.col(key).alias("_id")).alias("_at"), fingerprint(F.col(text)).alias("_sha"))
    ensure_checkpoints(rows.sparkSession)
    # Written (a hash a row): it is read twice, and texts need not be.
    narrow = narrow.checkpoint()
    first = narrow.groupBy("_sha").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = narrow.join(first, "_sha").where(F.col("_at") != F.col("_first"))
    return found.select(F.col("_key").alias(key), F.col("_first._id").alias("first_id"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot / size)


def compact(vector: Column, dims: int = 256, places: int = 4) -> Column:
    """The first ``dims`` numbers, rounded."""
    return F.transform(F.slice(vector, 1, dims), lambda x: F.round(x.cast("double"), places))


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``n``, its place from 0 by ``order``, counted by ranges instead of in one task."""
    ensure_checkpoints(df.sparkSession)
    parts = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    # Written out, as places would shift if a lost executor had the ranges drawn again.
    parts = parts.checkpoint()
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn("n", F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_b", "_m")


def _unit(v: pd.Series) -> np.ndarray:
    """Vectors as rows of length one (zero vectors stay)."""
    m = np.array(v.tolist(), float).reshape(len(v), -1)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def cells(vectors: DataFrame, threshold: float, block: int, pivots: int = PIVOTS) -> DataFrame:
    """Vectors dealt to cells such that every pair of cosine at least ``threshold`` meets in one: (cell, own, and all columns).

    A cell has the vectors that lie nearest its pivot (``own``), and of cells of lower number those that the triangle
    inequality of angles cannot keep off: whose angle to the pivot is at most the cell's radius and the threshold's angle. So
    a vector visits few cells where vectors cluster, and no pair is missed anywhere. Pivots are ``pivots`` vectors at most,
    whatever the number of vectors, taken by hash. Zero vectors are similar to nothing and left out; for a threshold
    of zero or less all are in one cell.
    """
    if threshold <= 0:
        return vectors.select(F.lit(0).alias("cell"), F.lit(True).alias("own"), *vectors.columns)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    some = vectors.where(length > 0)
    wanted = min(pivots, max(1, 2 * some.count() // block))
    if wanted == 1:
        return some.select(F.lit(0).alias("cell"), F.lit(True).alias("own"), *vectors.columns)
    at = _unit(pd.Series([r["v"] for r in some.orderBy(F.xxhash64("n"), "n").limit(wanted).select("v").collect()]))

    def angles(v: pd.Series) -> np.ndarray:
        return np.arccos(np.clip(_unit(v) @ at.T, -1, 1))

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        found = angles(v)
        cell = found.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": found[np.arange(len(cell)), cell]})

    radius = np.full(len(at), -np.inf)
    for r in some.select(nearest("v").alias("c")).groupBy("c.cell").agg(F.max("c.angle").alias("r")).collect():
        radius[r["cell"]] = r["r"]
    reach = radius + np.arccos(min(1.0, threshold)) + 1e-6

    @F.pandas_udf("array<int>")
    def dealt(v: pd.Series) -> pd.Series:
        found = angles(v)
        cell = found.argmin(axis=1)
        near = (found <= reach) & (np.arange(len(at)) > cell[:, None])
        return pd.Series([np.r_[c, np.flatnonzero(x)].astype(np.int32) for c, x in zip(cell, near)])

    placed = some.select(*vectors.columns, F.posexplode(dealt("v")).alias("_visit", "cell"))
    loads = placed.groupBy("cell").agg(F.count_if(F.col("_visit") == 0).alias("own"), F.count_if(F.col("_visit") > 0).alias("visits")).collect()
    n, dealt_rows, work = (sum(f(r) for r in loads) for f in (lambda r: r["own"], lambda r: r["own"] + r["visits"], lambda r: r["own"] * (r["own"] / 2 + r["visits"])))
    if dealt_rows > GRID / 2 * n or work > n * n / 8:
        # Vectors that do not cluster visit so many cells that these only multiply the rows.
        return some.select(F.lit(0).alias("cell"), F.lit(True).alias("own"), *vectors.columns)
    return placed.select("cell", (F.col("_visit") == 0).alias("own"), *vectors.columns)


def similar_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK, group: str | None = None, pivots: int = PIVOTS) -> DataFrame:
    """Pairs i < j (by place n) of cosine at least ``threshold``, of one ``group`` if that is given: (i, j, sim).

    vectors: n long, v array<double>, of one length. Vectors are dealt to cells (see cells()), and within a cell and
    group its own vectors are compared with one another and with the visitors, by pairs of blocks, each in one task. There are at
    most GRID blocks of a kind, so the rows that are sent grow as the input does, until a block would pass BLOCK_BYTES:
    memory is bounded by two blocks and a product of ``block`` by ``block`` however large a group or a cluster is. Exact.
    """
    rows = cells(vectors.select("n", "v", (F.col(group) if group else F.lit(0)).alias("g")), threshold, block, pivots)
    size = F.max(F.size("v"))

    def blocks(n: Column) -> Column:
        return F.greatest(F.least(F.ceil(n / block), F.lit(GRID)), F.ceil(n * size * 8 / BLOCK_BYTES)).cast("int")

    sizes = rows.groupBy(F.col("g").alias("_g"), F.col("cell").alias("_cell")).agg(F.greatest(blocks(F.count_if("own")), F.lit(1)).alias("owns"), blocks(F.count_if(~F.col("own"))).alias("visits"))
    rows = rows.join(sizes, F.col("g").eqNullSafe(F.col("_g")) & (F.col("cell") == F.col("_cell")))
    b = F.pmod(F.xxhash64("n"), F.when(F.col("own"), F.col("owns")).otherwise(F.greatest("visits", F.lit(1)))).cast("int").alias("b")
    rows = rows.select("n", "v", "g", "cell", "own", "owns", "visits", b)
    # Block pairs: lo and hi both own, or lo own and hi a block of visitors, which are numbered from -1 down.
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    mine = F.concat(F.transform(upto(F.col("owns")), lambda o: pair(F.least(o, F.col("b")), F.greatest(o, F.col("b")))), F.transform(upto(F.col("visits")), lambda k: pair(F.col("b"), -1 - k)))
    theirs = F.transform(upto(F.col("owns")), lambda o: pair(o, -1 - F.col("b")))
    dealt = rows.select("n", "v", "g", "cell", "own", "b", F.explode(F.when(F.col("own"), mine).otherwise(theirs)).alias("p")).select("n", "v", "own", "b", "g", "cell", "p.lo", "p.hi")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[2], key[3]
        own = rows["own"].to_numpy()
        left = rows[own & (rows["b"].to_numpy() == lo)]
        right = rows[own & (rows["b"].to_numpy() == hi)] if hi >= 0 else rows[~own]
        na, nb = left["n"].to_numpy(), right["n"].to_numpy()
        if not len(na) or not len(nb):
            return pd.DataFrame({"i": na[:0], "j": na[:0], "sim": np.zeros(0)})
        us, vs, found = _unit(left["v"]), _unit(right["v"]), []
        for p in range(0, len(na), block):
            for q in range(0, len(nb), block):
                sims = us[p : p + block] @ vs[q : q + block].T
                i, j = np.nonzero(sims >= threshold)
                a, b = na[p + i], nb[q + j]
                keep = a < b if lo == hi else a != b
                found.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], sims[i, j][keep]))
        return pd.DataFrame({k: np.concatenate([f[c] for f in found]) for c, k in enumerate(("i", "j", "sim"))})

    return dealt.groupBy("g", "cell", "lo", "hi").applyInPandas(compare, "i long, j long, sim double")


def greedy_survivors(edges: DataFrame) -> DataFrame:
    """Of edges (i, j, sim) with i < j: the dropped nodes with partner and sim, as a scan in order drops them.

    The scan keeps a node unless a kept node before it is its neighbour. Rounds reach the same:
    drop what has a kept earlier neighbour, keep what has only dropped ones. Each round is
    checkpointed; there are as many as the longest chain of such dependencies, and each settles the
    first open node at least.
    """
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    edges = edges.checkpoint()
    nodes = edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct()
    state = nodes.join(edges.select(F.col("j").alias("node")).distinct().withColumn("later", F.lit(True)), "node", "left").select("node", F.when(F.col("later").isNull(), F.lit("kept")).otherwise(F.lit("open")).alias("state")).checkpoint()
    while not state.where("state = 'open'").isEmpty():
        seen = edges.join(state.withColumnRenamed("node", "i"), "i").groupBy("j").agg(F.max((F.col("state") == "kept").cast("int")).alias("hit"), F.min((F.col("state") == "dropped").cast("int")).alias("free"))
        step = state.join(seen.withColumnRenamed("j", "node"), "node", "left")
        state = step.select("node", F.when(F.col("state") != "open", F.col("state")).when(F.col("hit") == 1, F.lit("dropped")).when(F.col("free") == 1, F.lit("kept")).otherwise(F.lit("open")).alias("state")).checkpoint()
    kept = state.where("state = 'kept'").select(F.col("node").alias("i"))
    return edges.join(kept, "i").groupBy("j").agg(F.min(F.struct("i", "sim")).alias("by")).select(F.col("j").alias("n"), F.col("by.i").alias("partner"), F.col("by.sim").alias("sim"))


def _scan(n: np.ndarray, u: np.ndarray, fixed: np.ndarray, threshold: float, tile: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy scan of vectors in order: which are kept, and of each other one the first kept neighbour's place and similarity."""
    kept, by, sim = np.zeros(0, np.int64), np.full(len(n), -1), np.zeros(len(n))
    for p in range(0, len(n), tile):
        at = np.arange(p, min(p + tile, len(n)))
        before, own = u[at] @ u[kept].T, u[at] @ u[at].T
        for k in range(len(at)):
            if fixed[at[k]]:
                continue
            hit = np.flatnonzero(before[k] >= threshold)[:1]
            if len(hit):
                by[at[k]], sim[at[k]] = kept[hit[0]], before[k, hit[0]]
                continue
            hit = np.flatnonzero((own[k, :k] >= threshold) & (by[at[:k]] < 0))[:1]
            if len(hit):
                by[at[k]], sim[at[k]] = at[hit[0]], own[k, hit[0]]
        kept = np.concatenate([kept, at[by[at] < 0]])
    return kept, by, sim


def greedy_scan(vectors: DataFrame, threshold: float, block: int = BLOCK, look: int | None = None) -> DataFrame:
    """The nodes that a greedy scan in order of n drops: n, partner (the first kept neighbour) and sim.

    vectors: n long, v array<double>, g string (only vectors of one g are neighbours), fixed boolean (never dropped). A round
    scans the first open vectors of each group in one task, bounded by LOOK in all, and drops everything after them that is a
    neighbour of one they keep. Where many vectors are neighbours, few are kept, and the rounds end soon without
    listing the neighbours, whose number grows with the square of the input. Where a round drops little, neighbours are
    few, and those among what is left are listed (similar_pairs()) and settled (greedy_survivors()).
    """
    ensure_checkpoints(vectors.sparkSession)
    open_ = vectors.select("n", "v", "g", "fixed").checkpoint()
    told = open_.agg(F.count_if(~F.col("fixed")).alias("rest"), F.max(F.size("v")).alias("dims"), F.approx_count_distinct("g").alias("groups")).first()
    rest, dims, out = told["rest"], max(told["dims"] or 1, 1), []
    each = (look or max(1024, min(LOOK, LOOK_BYTES // (8 * dims)))) // max(told["groups"], 1)

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        u, n = _unit(rows["v"]), rows["n"].to_numpy()
        kept, by, sim = _scan(n, u, rows["fixed"].to_numpy(bool), threshold)
        return pd.DataFrame({"g": rows["g"], "n": n, "partner": np.where(by < 0, -1, n[by]), "sim": sim, "kept": by < 0, "v": rows["v"]})

    while rest and each:
        narrow = open_.select("n", "g", F.row_number().over(Window.partitionBy("g").orderBy("n")).alias("_k")).where(F.col("_k") <= each).select(F.col("n").alias("_n"))
        head = open_.join(F.broadcast(narrow), F.col("n") == F.col("_n"), "left_semi").groupBy("g").applyInPandas(first, "g string, n long, partner long, sim double, kept boolean, v array<double>").checkpoint()
        done = {r["g"]: r["last"] for r in head.groupBy("g").agg(F.max("n").alias("last")).collect()}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        rows = head.where("kept").select("g", "n", "v").orderBy("n").toPandas()
        for g, own in rows.groupby("g"):
            held[g] = own["n"].to_numpy(), _unit(own["v"])

        @F.pandas_udf("struct<partner:long,sim:double>")
        def dropped(g: pd.Series, v: pd.Series, fixed: pd.Series) -> pd.DataFrame:
            partner, sim = np.full(len(g), -1, np.int64), np.zeros(len(g))
            u = _unit(v)
            for name, at in pd.Series(np.arange(len(g))).groupby(g.to_numpy()):
                at = at.to_numpy()
                at = at[~fixed.to_numpy(bool)[at]]
                if name not in held:
                    continue
                ids, kept = held[name]
                for p in range(0, len(kept), 1024):
                    at = at[partner[at] < 0]
                    if not len(at):
                        break
                    sims = u[at] @ kept[p : p + 1024].T
                    hit = sims >= threshold
                    one, where = hit.any(axis=1), hit.argmax(axis=1)
                    partner[at[one]] = ids[p + where[one]]
                    sim[at[one]] = sims[one, where[one]]
            return pd.DataFrame({"partner": partner, "sim": sim})

        last = vectors.sparkSession.createDataFrame(list(done.items()), "_g string, _last long")
        after = open_.join(F.broadcast(last), F.col("g") == F.col("_g"), "left").where(F.col("_last").isNull() | (F.col("n") > F.col("_last")))
        judged = after.select("n", "v", "g", "fixed", dropped("g", "v", "fixed").alias("d"))
        judged = judged.select("n", F.when(F.col("d.partner") < 0, F.col("v")).alias("v"), "g", "fixed", F.when(F.col("d.partner") >= 0, F.col("d")).alias("d")).checkpoint()
        out += [head.where("NOT kept").select("n", "partner", "sim"), judged.where("d IS NOT NULL").select("n", "d.partner", "d.sim")]
        open_ = judged.where("d IS NULL").select("n", "v", "g", "fixed")
        left = open_.where("NOT fixed").count()
        went, before, rest = judged.where("d IS NOT NULL").count(), rest, left
        if went < YIELD * (went + left) or before == left:
            break
    if rest or not out:
        edges = similar_pairs(open_, threshold, block, "g").join(open_.where("NOT fixed").select(F.col("n").alias("j")), "j", "left_semi").select("i", "j", "sim")
        out.append(greedy_survivors(edges))
    gone = out[0]
    for more in out[1:]:
        gone = gone.unionByName(more)
    return gone


def near_dup(vectors: DataFrame, threshold: float = 0.92, order: Sequence[str] = ("id",), key: str = "id", vector: str = "v") -> DataFrame:
    """Rows dropped by the greedy scan over cosines: key, partner and similarity. Rows without a vector take no part.

    Equal vectors are one from the start, so copies of any number are no pairs: the scan drops each copy by the partner of the
    first, or by the first itself where that stays.
    """
    rows = numbered(vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)), order)
    rows = rows.select("n", F.col(key).alias("_key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    # A zero vector is similar to nothing, itself among it; beyond this threshold rounding decides, and copies are compared.
    alike = (length > 0) & F.lit(0 < threshold <= 1 - 1e-9)
    rows = rows.withColumn("_same", F.when(alike, F.sha2(F.to_json(F.struct("v")), 256)).otherwise(F.col("n").cast("string")))
    first = rows.groupBy(F.col("_same").alias("_class")).agg(F.min("n").alias("first"))
    rows = rows.join(first, F.col("_same") == F.col("_class")).select("n", "_key", "v", "first")
    gone = greedy_scan(rows.where(F.col("n") == F.col("first")).select("n", "v", F.lit("").alias("g"), F.lit(False).alias("fixed")), threshold)
    told = gone.select(F.col("n").alias("_gone"), F.col("partner").alias("_partner"), F.col("sim").alias("_sim"))
    copies = rows.select("n", "_key", "first").join(told, F.col("first") == F.col("_gone"), "left")
    dropped = copies.where(F.col("_gone").isNotNull() | (F.col("n") != F.col("first"))).select(F.col("_key").alias("_dropped"), F.coalesce("_partner", "first").alias("partner"), F.coalesce("_sim", F.lit(1.0)).alias("sim"))
    out = dropped.join(rows.select(F.col("n").alias("partner"), F.col("_key").alias("_other")), "partner")
    return out.select(F.col("_dropped").alias(key), F.col("_other").alias("partner_id"), "sim")


def dup_mask(new: DataFrame, existing: DataFrame, threshold: float, group: str, order: str = "n", vector: str = "v", block: int = BLOCK, look: int | None = None) -> DataFrame:
    """``new`` with ``dup``: similar to an existing vector of its group, or to an earlier new one that is none.

    The greedy scan (greedy_scan()) with the existing vectors first, none of which is ever dropped. Rows without a vector
    are no duplicates; rows without a group form one.
    """
    kind = new.schema[order].dataType
    own = new.select(F.col(group).alias("_g"), F.lit(1).alias("_new"), F.col(order).alias("_at"), F.lit(None).cast("array<double>").alias("_old"), F.struct(*[F.col(c) for c in new.columns]).alias("_row"))
    old = existing.where(F.col(vector).isNotNull()).select(group, F.lit(0), F.lit(None).cast(kind), F.col(vector).cast("array<double>"), F.lit(None).cast(new.schema))
    rows = numbered(own.union(old), ["_g", "_new", "_at"])
    vectors = rows.select("n", F.to_json(F.struct("_g")).alias("g"), F.coalesce("_old", F.col("_row")[vector].cast("array<double>")).alias("v"), (F.col("_new") == 0).alias("fixed")).where("v IS NOT NULL")
    asked = rows.where("_new = 1")
    gone = greedy_scan(vectors, threshold, block, look).select("n", F.lit(True).alias("_dup"))
    return asked.join(gone, "n", "left").select("_row.*", F.coalesce("_dup", F.lit(False)).alias("dup"))


def ensure_checkpoints(spark) -> None:  # noqa: ANN001
    """A checkpoint folder where a local session has none; elsewhere spark.checkpoint.dir must name a shared one."""
    import os
    import tempfile

    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-", dir="/tmp/checkpoints"))


