"""The topic tree: paths, replacement with all that hangs on it, planned rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import slugify
from weftline.operators.dedup import ensure_checkpoints, numbered
from weftline.sources.commitlog import Snapshots


def chains(nodes: DataFrame, id_: str = "id", parent: str = "parent_id", carry: str | None = None) -> DataFrame:
    """id, chain and cyclic: the ids (or ``carry`` of them) from every node up to its root, the node first.

    Pointers are doubled: after k rounds a node's chain has 2**k nodes, so a tree of any depth takes the logarithm of
    its depth in joins, each round a written table. A parent that is not there counts as none. A node in or below a
    cycle is ``cyclic``; its chain ends before the first node that would come again.
    """
    ensure_checkpoints(nodes.sparkSession)
    own = F.col(carry or id_)
    base = nodes.select(F.col(id_).alias("id"), F.col(parent).alias("_p"), own.alias("_v"))
    known = nodes.select(F.col(id_).alias("_known")).distinct()
    now = base.join(known, F.col("_p") == F.col("_known"), "left").select("id", F.col("_known").alias("jump"), F.array("id").alias("ids"), F.array("_v").alias("chain"), F.lit(False).alias("cyclic")).checkpoint()
    while not now.where(F.col("jump").isNotNull()).isEmpty():
        up = now.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("ids").alias("_ids"), F.col("chain").alias("_chain"), F.col("cyclic").alias("_cyclic"))
        step = now.join(up, F.col("jump") == F.col("_id"), "left").select("id", F.col("_jump").alias("jump"), F.concat("ids", F.coalesce("_ids", F.slice("ids", 1, 0))).alias("ids"), F.concat("chain", F.coalesce("_chain", F.slice("chain", 1, 0))).alias("chain"), (F.col("cyclic") | F.coalesce("_cyclic", F.lit(False))).alias("cyclic"))
        again = F.size(F.array_distinct("ids")) < F.size("ids")
        # The chain of a node that meets itself again is cut there and goes no further.
        fresh = F.size(F.array_distinct("ids"))
        now = step.select("id", F.when(~again & ~F.col("cyclic"), F.col("jump")).alias("jump"), F.slice("ids", F.lit(1), fresh).alias("ids"), F.slice("chain", F.lit(1), fresh).alias("chain"), (F.col("cyclic") | again).alias("cyclic")).checkpoint()
    return now.select("id", "chain", "cyclic")


def paths(nodes: DataFrame, id_: str = "id", parent: str = "parent_id", label: str = "label") -> DataFrame:
    """Every node with its labels from the root, and whether it is in or below a cycle: id, path, cyclic."""
    return chains(nodes, id_, parent, label).select("id", F.reverse("chain").alias("path"), "cyclic")


def planned(nodes: DataFrame) -> DataFrame:
    """Leaves, negative leaves and planned rows."""
    return nodes.where("is_leaf").agg(F.count(F.lit(1)).alias("leaves"), F.count_if("is_negative").alias("negative"), F.sum(F.coalesce("rows_per_leaf", F.lit(0))).alias("target_rows"))


#: A slug that may also be a later one of a shorter slug: that slug and the number.
LATER = r"(?s)^(.*)-([1-9][0-9]{0,17})$"


def _placed(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_k``, their place from 0 within ``by``, counted by ranges so that a value of most rows lies in many tasks."""
    placed = numbered(rows, [by, *order])
    first = placed.groupBy(F.col(by).alias("_of")).agg(F.min("n").alias("_first"))
    return placed.join(first, F.col(by).eqNullSafe(F.col("_of"))).withColumn("_k", F.col("n") - F.col("_first")).drop("n", "_of", "_first")


def _settled(clashes: DataFrame) -> DataFrame:
    """Of the slugs that clash (family, longer, shorter, number, before): slug, base (whether its first row may have it) and from, or null.

    ``before`` counts the rows of the shorter slug before the first of the longer one. The rows that need a number take them in order, so the
    longer slug has lost its name if the row that comes to the number does so before; otherwise all rows from that one on pass over it.
    A family's slugs, not its rows, are in one task.
    """
    import pandas as pd

    def settle(pairs: pd.DataFrame) -> pd.DataFrame:
        lost, out = set(), []
        pairs = pairs.assign(_size=pairs["shorter"].str.len()).sort_values(["_size", "shorter", "number"])
        for slug, own in pairs.groupby("shorter", sort=False):
            base, passed = slug not in lost, 0
            for longer, number, before in zip(own["longer"], own["number"], own["before"]):
                at = number - 1 - passed
                if before - base >= at:
                    lost.add(longer)
                else:
                    out.append((slug, base, at))
                    passed += 1
        every = dict.fromkeys([*pairs["shorter"], *pairs["longer"]])
        return pd.DataFrame([(x, x not in lost, None) for x in every] + out, columns=["settled", "base", "from"]).astype({"from": "Int64"})

    return clashes.groupBy("family").applyInPandas(settle, "settled string, base boolean, `from` long")


def unique_slugs(nodes: DataFrame, slug: str = "slug", order: str = "order") -> DataFrame:
    """``nodes`` whose slugs are unique: later ones of a slug (by order, then id) get -2, -3 and so on, passing over taken ones.

    Rows are numbered within their slug by ranges, whatever the number of rows of one slug. A number can be taken by one other slug only,
    the one that is spelt so; where nodes have both and the numbers reach it, it is settled from counts which of them has it (see _settled()).
    """
    late = F.col(order).isNull()
    by = ["_late", order, "id"]
    rows = nodes.withColumn("_late", late)
    placed = _placed(rows, slug, by).checkpoint()
    known = placed.groupBy(F.col(slug).alias("_s")).agg(F.count(F.lit(1)).alias("_rows"), F.min(F.struct(*by)).alias("_at")).checkpoint()
    longer = known.select(F.col("_s").alias("longer"), F.col("_at"), F.regexp_extract("_s", LATER, 1).alias("shorter"), F.regexp_extract("_s", LATER, 2).try_cast("long").alias("number")).where("number >= 2")
    met = longer.join(known.select(F.col("_s").alias("_shorter"), "_rows"), F.col("shorter") == F.col("_shorter")).drop("_shorter")
    # Only as many numbers are reached as the shorter slug has rows and passes over.
    kin = met.groupBy(F.col("shorter").alias("_kin")).agg(F.count(F.lit(1)).alias("_longer"))
    met = met.join(kin, F.col("shorter") == F.col("_kin")).where(F.col("number") <= 1 + F.col("_rows") + F.col("_longer")).select("longer", "shorter", "number", "_at").checkpoint()
    name = lambda n: F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string")))
    if met.isEmpty():
        return placed.withColumn(slug, name(F.col("_k") + 1)).select(*nodes.columns)
    # The first rows of the longer slugs, put among those of the shorter one, count what comes before them.
    shorter = met.select(F.col("shorter").alias("_shorter")).distinct()
    none = F.lit(None)
    own = placed.join(shorter, F.col(slug) == F.col("_shorter"), "left_semi").select(F.col(slug).alias("_s"), *by, none.cast("string").alias("longer"), none.cast("long").alias("number"))
    marks = met.select("shorter", *[F.col("_at")[c] for c in by], "longer", "number")
    marks = _placed(own.union(marks), "_s", by).where("longer IS NOT NULL")
    before = F.col("_k") - F.row_number().over(Window.partitionBy("_s").orderBy("_k")) + 1
    clashes = marks.select(F.regexp_replace("_s", "(-[0-9]+)+$", "").alias("family"), "longer", F.col("_s").alias("shorter"), "number", before.alias("before"))
    settled = _settled(clashes).checkpoint()
    # Likewise the rows from which a number is passed over, put among the rows, count what each row passes over.
    base = settled.where(F.col("from").isNull()).select(F.col("settled").alias("_settled"), F.when(F.col("base"), 0).otherwise(1).alias("_shift"))
    rest = placed.join(base, F.col(slug) == F.col("_settled"), "left")
    hit = rest.where("_settled IS NOT NULL").select(F.col(slug).alias("_s"), (F.col("_k") + F.col("_shift")).alias("_j"), F.lit(1).alias("_kind"), F.col("_k").alias("_own"), F.struct(*[F.col(c) for c in nodes.columns]).alias("_row"))
    steps = settled.where(F.col("from").isNotNull()).select("settled", "from", F.lit(0), none.cast("long"), none.cast(nodes.schema))
    hit = _placed(hit.union(steps), "_s", ["_j", "_kind"]).where("_kind = 1")
    hit = hit.select("_row.*", (1 + F.col("_j") + F.col("_k") - F.col("_own")).alias("_n"))
    free = rest.where("_settled IS NULL").select(*nodes.columns, (F.col("_k") + 1).alias("_n"))
    return free.unionByName(hit).withColumn(slug, name(F.col("_n"))).select(*nodes.columns)


def marked_negative(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``nodes`` with the given ones and all below them negative, at any depth."""
    above = chains(nodes).select(F.col("id").alias("_id"), F.explode("chain").alias("_up"))
    hit = above.join(ids.select(F.col("id").alias("_given")).distinct(), F.col("_up") == F.col("_given"), "left_semi").select("_id").distinct()
    out = nodes.join(hit, F.col("id") == F.col("_id"), "left")
    return out.withColumn("is_negative", F.coalesce(F.col("is_negative"), F.lit(False)) | F.col("_id").isNotNull()).select(*nodes.columns)


TREE = "key string, parent_key string, id string, label string, slug string, is_negative boolean, `order` int, difficulty string, task_type string, rows_per_leaf int"


def replacement(old: DataFrame, new: DataFrame, project_id: str, rows_per_leaf: int) -> DataFrame:
    """The nodes (as TOPIC_NODES) of a project's new tree, given as TREE: each node has a key, and an id if it is to be kept.

    A known id stays and keeps its label and slug where the new ones are empty; other nodes get an id made of the
    project and their key and place. Depth, leaves and inherited negativity follow from the tree. Leaf slugs are unique
    in order of the walk (a node before its children, siblings by order): later ones get -2, -3 and so on. Only leaves
    have a difficulty, a task type and rows. A tree with a cycle, a repeated key or a repeated id is refused.
    """
    kept = old.where(F.col("project_id") == project_id).select(F.col("id").alias("_id"), F.col("label").alias("_label"), F.col("slug").alias("_slug"))
    # Siblings are numbered, so that the numbers from the root sort nodes in order of the walk.
    place = F.row_number().over(Window.partitionBy("parent_key").orderBy(F.coalesce("order", F.lit(0)), "key")) - 1
    placed = new.withColumns({"order": F.coalesce("order", place).cast("int"), "_place": place})
    # Keys and numbers go up in one walk, since each walk is a join and a written table for every doubling of the depth.
    above = chains(placed.withColumn("_step", F.struct("key", "_place")), "key", "parent_key", "_step")
    if not above.where("cyclic").isEmpty() or not new.groupBy("key").count().where("count > 1").isEmpty() or not new.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("a tree must have no cycle, and no key or id twice")
    walk = above.select(F.col("id").alias("_key"), F.transform(F.reverse("chain"), lambda x: F.lpad(x["_place"].cast("string"), 10, "0")).alias("_walk"))
    bad = placed.where(F.coalesce("is_negative", F.lit(False))).select(F.col("key").alias("_bad"))
    negative = above.select(F.col("id").alias("_neg"), F.explode("chain.key").alias("_up")).join(bad, F.col("_up") == F.col("_bad"), "left_semi").select("_neg").distinct()
    inner = new.select(F.col("parent_key").alias("_inner")).where("_inner IS NOT NULL").distinct()
    known = placed.join(kept, F.col("id") == F.col("_id"), "left").join(walk, F.col("key") == F.col("_key")).join(negative, F.col("key") == F.col("_neg"), "left").join(inner, F.col("key") == F.col("_inner"), "left")
    leaf = F.col("_inner").isNull()
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("_label"), F.lit("Untitled"))
    slug = F.coalesce(F.nullif("slug", F.lit("")), "_slug")
    made = F.substring(F.sha2(F.concat_ws("|", F.lit(project_id), "key", F.array_join("_walk", ".")), 256), 1, 32)
    nodes = known.select("key", "parent_key", F.coalesce("_id", made).alias("id"), label.alias("label"), F.when(leaf, slugify(F.coalesce(slug, label))).otherwise(F.coalesce(slug, slugify(label))).alias("slug"), leaf.alias("is_leaf"), F.col("_neg").isNotNull().alias("is_negative"), "_walk", "order", "difficulty", "task_type", "rows_per_leaf").checkpoint()
    leaves = unique_slugs(nodes.where("is_leaf").select(F.col("key").alias("id"), "slug", F.array_join("_walk", ".").alias("order"))).select(F.col("id").alias("_leaf"), F.col("slug").alias("_unique"))
    parents = nodes.select(F.col("key").alias("_pkey"), F.col("id").alias("_pid"))
    out = nodes.join(leaves, F.col("key") == F.col("_leaf"), "left").join(parents, F.col("parent_key") == F.col("_pkey"), "left")
    only = lambda c: F.when(F.col("is_leaf"), c)
    return out.select(
        "id", F.lit(project_id).alias("project_id"), F.col("_pid").alias("parent_id"), "label", F.coalesce("_unique", "slug").alias("slug"), only(F.col("difficulty")).alias("difficulty"), only(F.col("task_type")).alias("task_type"),
        (F.size("_walk") - 1).cast("int").alias("depth"), only(F.coalesce(F.nullif("rows_per_leaf", F.lit(0)), F.lit(rows_per_leaf))).cast("int").alias("rows_per_leaf"), "order", "is_negative", "is_leaf",
    )


def cascaded(tables: Mapping[str, DataFrame], gone: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that change when rows of ids ``gone`` (by table) go: what hangs on them goes or forgets them.

    Project -> runs, nodes, prompts, rows; run -> items; node -> child nodes and prompts; prompt -> its rows forget it; row ->
    pairs. Every step is an anti join by key; the ids that go are joined, never collected.
    """
    gone, out = {k: v.select("id") for k, v in gone.items()}, {}
    for name, parent, column, action in CASCADES:
        if parent not in gone or name not in tables:
            continue
        now = out.get(name, tables[name])
        ids = gone[parent].select(F.col("id").alias("_gone")).distinct()
        if action == "forget":
            hit = now.join(ids, F.col(column) == F.col("_gone"), "left")
            out[name] = hit.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*now.columns)
            continue
        lost = now.join(ids, F.col(column) == F.col("_gone"), "left_semi").select("id")
        if name == parent:
            # Whole subtrees go, however deep.
            above = chains(tables[name]).select(F.col("id").alias("_id"), F.explode("chain").alias("_up"))
            lost = above.join(ids, F.col("_up") == F.col("_gone"), "left_semi").select(F.col("_id").alias("id"))
        gone[name] = gone[name].unionByName(lost).distinct() if name in gone else lost
        out[name] = now
    for name, ids in gone.items():
        if name in tables:
            now = out.get(name, tables[name])
            out[name] = now.join(ids.select(F.col("id").alias("_gone")).distinct(), F.col("id") == F.col("_gone"), "left_anti")
    return out


#: (table, the table it hangs on, by which column, what happens to it), parents first.
CASCADES = (
    ("runs", "projects", "project_id", "go"),
    ("run_items", "runs", "run_id", "go"),
    ("topic_nodes", "projects", "project_id", "go"),
    ("topic_nodes", "topic_nodes", "parent_id", "go"),
    ("prompts", "projects", "project_id", "go"),
    ("prompts", "topic_nodes", "leaf_id", "go"),
    ("rows", "projects", "project_id", "go"),
    ("rows", "prompts", "prompt_id", "forget"),
    ("pairs", "rows", "row_id", "go"),
)


def replace_tree(store: Snapshots, project_id: str, tree: DataFrame, rows_per_leaf: int = 4, before_commit: Callable[[], None] | None = None) -> int:
    """Replaces a project's tree in a store of topic_nodes, prompts, rows: nodes that are no longer there go with their prompts.

    All tables change in one commit: a reader sees the old tree with its prompts or the new one, nothing between. Returns
    the version; Conflict where another commit came first.
    """
    base, _ = store.version()
    tables = store.read()
    nodes = tables["topic_nodes"]
    new = replacement(nodes, tree, project_id, rows_per_leaf).checkpoint()
    own = nodes.where(F.col("project_id") == project_id)
    stale = own.join(new.select(F.col("id").alias("_kept")), F.col("id") == F.col("_kept"), "left_anti").select("id")
    # Kept nodes hang on new parents by now, so only what is stale cascades to prompts and rows.
    changed = cascaded({k: v for k, v in tables.items() if k != "topic_nodes"}, {"topic_nodes": stale})
    others = nodes.where(~F.col("project_id").eqNullSafe(F.lit(project_id)))
    return store.commit(base, {**changed, "topic_nodes": others.unionByName(new)}, before_commit)


def delete_project(store: Snapshots, project_id: str) -> int:
    """Deletes a project with all that hangs on it, in one commit."""
    base, _ = store.version()
    tables = store.read()
    return store.commit(base, cascaded(tables, {"projects": tables["projects"].where(F.col("id") == project_id)}))


def resample_leaf(store: Snapshots, leaf_id: str) -> int:
    """Deletes a leaf's active prompts that no row uses (a plan then asks for that many again), in one commit."""
    base, _ = store.version()
    tables = store.read()
    used = tables["rows"].where("prompt_id IS NOT NULL").select(F.col("prompt_id").alias("_used"))
    unused = tables["prompts"].where((F.col("leaf_id") == leaf_id) & (F.col("status") == "active")).join(used, F.col("id") == F.col("_used"), "left_anti")
    return store.commit(base, cascaded({"prompts": tables["prompts"]}, {"prompts": unused}))


def needed_prompts(nodes: DataFrame, prompts: DataFrame, force: bool = False) -> DataFrame:
    """Prompts still wanted by each leaf."""
    have = prompts.where("status = 'active'").groupBy("leaf_id").agg(F.count(F.lit(1)).alias("have"))
    leaves = nodes.where("is_leaf").select(F.col("id").alias("leaf_id"), F.coalesce("rows_per_leaf", F.lit(0)).alias("wanted"))
    n = F.col("wanted") if force else F.greatest(F.lit(0), F.col("wanted") - F.coalesce("have", F.lit(0)))
    return leaves.join(have, "leaf_id", "left").select("leaf_id", n.cast("int").alias("n"))


def renumbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``order`` counted from 0 among siblings."""
    return nodes.withColumn("order", (F.row_number().over(Window.partitionBy("parent_id").orderBy("order", "id")) - 1).cast("int"))
