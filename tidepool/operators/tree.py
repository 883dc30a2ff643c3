"""Trees over keys: rows, ancestors, visibility, selection and moves, as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rows(objects: DataFrame) -> DataFrame:
    """(id, parent_id, depth, is_group, idx): a node for every folder (its id ends in /) and key; folders come before keys among siblings."""
    keys = objects.select("key").distinct().withColumn("p", F.split("key", "/")).withColumn("n", F.size("p"))
    own = keys.select("key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("d"), "p", "n")
    path = F.array_join(F.slice("p", 1, F.col("d")), "/")
    node = F.when(F.col("d") < F.col("n"), F.concat(path, F.lit("/"))).otherwise(path)
    parent = F.when(F.col("d") > 1, F.concat(F.array_join(F.slice("p", 1, F.col("d") - 1), "/"), F.lit("/")))
    nodes = own.select(node.alias("id"), parent.alias("parent_id"), (F.col("d") - 1).cast("int").alias("depth"), (F.col("d") < F.col("n")).alias("is_group")).where("id <> coalesce(parent_id, '')").distinct()
    at = Window.partitionBy("parent_id").orderBy(F.col("is_group").desc(), "id")
    return nodes.withColumn("idx", (F.row_number().over(at) - 1).cast("int"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance): nearest first. Ids are paths, so no recursion is needed."""
    base = F.split(F.regexp_replace("id", "/$", ""), "/")
    each = nodes.select("id", base.alias("p")).where(F.size("p") > 1).select("id", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    return each.select("id", F.concat(F.array_join(F.slice("p", 1, F.col("k")), "/"), F.lit("/")).alias("ancestor"), (F.size("p") - F.col("k")).alias("distance"))


def descendants(nodes: DataFrame, of: list[str]) -> DataFrame:
    return ancestors(nodes).where(F.col("ancestor").isin(of)).select("id").distinct()


def visible(nodes: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Nodes with no collapsed group(id) above them."""
    hidden = ancestors(nodes).join(collapsed.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    return nodes.join(hidden.distinct(), "id", "left_anti")


def positions(nodes: DataFrame, prefix: str = "", buckets: int = 256) -> DataFrame:
    """Rows under one folder (all, without a prefix) with their place in reading order.

    Ids picked by their hash, `buckets` at most, part the rows into ranges of about one size, however many lie under one
    folder; places are counted within a range, and the rows of the ranges before are added.
    """
    shown = nodes.where(F.col("id").startswith(prefix)) if prefix else nodes
    cuts = shown.select("id").orderBy(F.xxhash64("id"), "id").limit(buckets - 1).agg(F.sort_array(F.collect_list("id")).alias("cuts"))
    ranged = shown.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c <= F.col("id")))).drop("cuts")  # one row
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a number for each range
    first = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = ranged.withColumn("pos", F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1).join(F.broadcast(first), "range")
    return placed.select(*nodes.columns, (F.col("pos") + F.col("first")).alias("pos"))


def select_range(placed: DataFrame, anchor: str, target: str) -> DataFrame:
    """Rows between two rows; only the target if the anchor is not shown."""
    ends = placed.agg(F.max(F.when(F.col("id") == anchor, F.col("pos"))).alias("a"), F.max(F.when(F.col("id") == target, F.col("pos"))).alias("b"))
    both = placed.join(F.broadcast(ends))  # one row
    return both.where("pos between least(coalesce(a, b), b) and greatest(coalesce(a, b), b)").select("id", "pos")


def sibling_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("parent_id").agg(F.count("*").alias("siblings"))


def siblings_groups(nodes: DataFrame, focus: str) -> DataFrame:
    """All groups that share the focused node's parent; roots share none, null-safely."""
    parent = nodes.where(F.col("id") == focus).select(F.col("parent_id").alias("p"))
    return nodes.join(F.broadcast(parent), F.col("parent_id").eqNullSafe(F.col("p"))).where("is_group").select("id")  # ids are unique: one row


def removed(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Without ids and what is below them, siblings numbered anew."""
    gone = descendants(nodes, ids)
    left = nodes.where(~F.col("id").isin(ids)).join(gone, "id", "left_anti")
    return left.withColumn("idx", (F.row_number().over(Window.partitionBy("parent_id").orderBy("idx")) - 1).cast("int"))


def inserted(nodes: DataFrame, new: DataFrame, before: str) -> DataFrame:
    """Nodes and new(id, place) ones ahead of `before`, in order of place; the siblings are numbered anew.

    If `before` is not a node, the new ones come last among the roots.
    """
    at = nodes.where(F.col("id") == before).select("parent_id", "idx").first()  # ids are unique: one row
    parent, idx = (at["parent_id"], at["idx"]) if at else (None, 2**31 - 1)
    added = new.select("id", F.lit(parent).cast("string").alias("parent_id"), F.lit(idx).alias("idx"), F.lit(0).alias("old"), F.col("place").cast("long").alias("place"))
    both = nodes.select("id", "parent_id", "idx", F.lit(1).alias("old"), F.lit(0).cast("long").alias("place")).unionByName(added)
    beside = Window.partitionBy("parent_id").orderBy("idx", "old", "place")
    return both.select("id", "parent_id", (F.row_number().over(beside) - 1).cast("int").alias("idx"))


def collapsed(opened: DataFrame, ids: list[str]) -> DataFrame:
    """The opened groups(id) after `ids` are closed: without them and without those below them."""
    return opened.where(~F.col("id").isin(ids)).join(descendants(opened, ids), "id", "left_anti")


def toggled(chosen: DataFrame, ids: DataFrame) -> DataFrame:
    """The selection(id) after each of ids(id) is toggled: the symmetric difference of the two sets."""
    both = chosen.select("id", F.lit(1).alias("n")).distinct().unionByName(ids.select("id", F.lit(1).alias("n")).distinct())
    return both.groupBy("id").agg(F.sum("n").alias("n")).where("n = 1").select("id")


def resolved(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The nodes of a selection(id); ids that name no node are dropped."""
    return nodes.join(chosen.select("id").distinct(), "id", "left_semi")


def selection_summary(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(files, folders) of a selection."""
    return resolved(nodes, chosen).agg(F.count_if(~F.col("is_group")).alias("files"), F.count_if("is_group").alias("folders"))


def without_nested(selected: DataFrame) -> DataFrame:
    """Selected ids without those below another selected one."""
    below = ancestors(selected).join(selected.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    return selected.join(below.distinct(), "id", "left_anti")


def keys_under(objects: DataFrame, folders: list[str]) -> DataFrame:
    """Keys under any of the selected folders, once each. The folders are the request's: a filter, not a join."""
    match = F.lit(False)
    for f in folders:
        match = match | F.col("key").startswith(f)
    return objects.where(match).select("key").distinct()


def moves(placed: DataFrame) -> DataFrame:
    """Next and previous row of each, clamped at the ends."""
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("n"))
    before = placed.select((F.col("pos") + 1).alias("pos"), F.col("id").alias("p"))
    both = placed.select("id", "pos").join(after, "pos", "left").join(before, "pos", "left")
    return both.select("id", F.coalesce("n", "id").alias("next"), F.coalesce("p", "id").alias("previous"))


def keyboard(placed: DataFrame) -> DataFrame:
    """For every shown row, where each key leads: up and down (held at the ends), home, end, left (the parent, if shown), right (the first shown child)."""
    ends = placed.agg(F.min_by("id", "pos").alias("home"), F.max_by("id", "pos").alias("end"))
    child = placed.groupBy(F.col("parent_id").alias("of")).agg(F.min_by("id", "pos").alias("right"))
    parents = placed.select(F.col("id").alias("left"))
    moved = placed.select("id", "parent_id").join(moves(placed), "id").join(F.broadcast(ends))  # one row
    moved = moved.join(parents, F.col("parent_id") == F.col("left"), "left").join(child, F.col("id") == F.col("of"), "left")
    return moved.select("id", F.col("previous").alias("up"), F.col("next").alias("down"), "home", "end", "left", "right")


def type_ahead(placed: DataFrame, focus: int, typed: str) -> DataFrame:
    """The first row after the focus whose label starts with what was typed, wrapping around."""
    n = placed.agg(F.count("*").alias("n"))
    label = F.lower(F.regexp_extract("id", "([^/]*)/?$", 1))
    found = placed.join(F.broadcast(n)).where(label.startswith(typed.lower()))  # one row
    return found.orderBy(F.pmod(F.col("pos") - focus - 1, F.col("n"))).limit(1).select("id", "pos")


def guides(placed: DataFrame) -> DataFrame:
    """(id, guide): depths above a row's own that occur again in a later row before the next root. The last place of each depth below each root tells."""
    rooted = placed.select("id", "pos", "depth", F.regexp_extract("id", "^[^/]*/?", 0).alias("root"))
    last = rooted.groupBy("root", F.col("depth").alias("guide")).agg(F.max("pos").alias("last"))  # as many rows as a key has parts, for each root
    return rooted.join(last, "root").where("guide < depth and last > pos and guide > 0").select("id", "guide")


def nested(nodes: DataFrame) -> DataFrame:
    """(id, children): every group with its direct children in order. Deeper levels join on id; depth is bounded by the keys'."""
    kids = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("idx", "id"))).alias("c"))
    return kids.select(F.col("parent_id").alias("id"), F.transform("c", lambda x: x["id"]).alias("children"))


def nested_below(nodes: DataFrame, levels: int) -> DataFrame:
    """(id, tree): the roots with what is below them as JSON, down to `levels` levels; a group's value is the list of its children."""
    said = nodes.where(~F.col("is_group") | (F.col("depth") >= levels)).select("id", "parent_id", "idx", "depth", F.to_json(F.struct("id")).alias("tree"))
    for depth in range(levels - 1, -1, -1):
        kids = said.where(F.col("depth") == depth + 1).groupBy(F.col("parent_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("idx", "tree"))).alias("c"))
        groups = nodes.where(F.col("is_group") & (F.col("depth") == depth)).join(kids, F.col("id") == F.col("of"), "left")
        text = F.concat(F.lit('{"id":"'), "id", F.lit('","children":['), F.coalesce(F.array_join(F.transform("c", lambda x: x["tree"]), ","), F.lit("")), F.lit("]}"))
        said = said.where(F.col("depth") <= depth).unionByName(groups.select("id", "parent_id", "idx", "depth", text.alias("tree")))
    return said.where("depth = 0").select("id", "tree")


def has_children(nodes: DataFrame, loaded: DataFrame) -> DataFrame:
    """(id, has): groups have children until they are loaded(id) and found empty."""
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("parent", F.lit(True))
    done = loaded.select("id").distinct().withColumn("loaded", F.lit(True))
    found = nodes.where("is_group").join(parents, "id", "left").join(done, "id", "left")
    return found.select("id", (F.col("loaded").isNull() | F.col("parent").isNotNull()).alias("has"))


def with_children(nodes: DataFrame, parent: str, children: DataFrame) -> DataFrame:
    """nodes and lazily loaded children(id, is_group) after those that the parent has already; ids that are there are left alone."""
    under = nodes.where(F.col("id") == parent).select((F.col("depth") + 1).alias("depth"))
    n = nodes.where(F.col("parent_id") == parent).agg(F.count("*").alias("n"))
    new = children.join(nodes.select("id"), "id", "left_anti").join(F.broadcast(under)).join(F.broadcast(n))  # a row each
    place = F.row_number().over(Window.partitionBy("n").orderBy("id")) - 1 + F.col("n")  # the children of one folder
    return nodes.unionByName(new.select("id", F.lit(parent).alias("parent_id"), F.col("depth").cast("int").alias("depth"), "is_group", place.cast("int").alias("idx")))
