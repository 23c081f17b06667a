"""Walks over the node graph for training sequences, each step one join for all walks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.running import running_sum
from lattica.tables import scratch_path, tasks_for, written

#: Parts in which the neighbours of a node are numbered.
PARTS = 64
#: Neighbours of one node beyond which they don't meet in one task.
HUB_ROWS = 200_000


def vocabulary(nodes: DataFrame) -> DataFrame:
    """(id, token): nodes numbered from 0 by path, position and id.

    The nodes are written, then dealt into ranges of the order with about TASK_ROWS nodes each. A range is sorted and
    its nodes are numbered in the same task, after the nodes of the ranges before it, so no task sorts the whole table.
    """
    named = written(nodes.select("id", "path", "position"), "vocabulary-nodes")
    order = ["path", "position", "id"]
    ranged = named.repartitionByRange(tasks_for(nodes.sparkSession, named.count()), *order).sortWithinPartitions(*order)
    # Spark numbers a partition's rows one after the other in the lower 33 bits, above them is the partition
    place = F.monotonically_increasing_id()
    ranged = written(ranged.select("id", place.alias("place")), "vocabulary")
    part, row = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("row")
    counts = ranged.select(part).groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = ranged.select("id", part, row).join(F.broadcast(starts), "part")
    return placed.select("id", (F.col("start") + F.col("row")).cast("long").alias("token"))


def to_tokens(walks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``walks`` (walk, step, node) with the token of each node; nodes that aren't in the vocabulary are left out."""
    named = vocabulary.select(F.col("id").alias("node"), "token")
    return walks.join(named, "node").select("walk", "step", "token")


def to_nodes(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(walk, step, node) of tokens (walk, step, token); unknown tokens are left out."""
    return tokens.join(vocabulary.select("token", F.col("id").alias("node")), "token").select("walk", "step", "node")


def in_order(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(place, id, kind, content) of the nodes that ``ids`` (ids, an array) name, in the order of the array."""
    listed = ids.select(F.posexplode("ids").alias("place", "id"))
    return listed.join(nodes.select("id", "kind", "content"), "id").select("place", "id", "kind", "content").orderBy("place")


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target): the tree and the edges in both directions, each once.

    Pairs of nodes are told apart whatever their direction, and then go both ways, so half of the rows are shuffled.
    """
    a, b = F.col("a"), F.col("b")
    tree = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("a"), F.col("id").alias("b"))
    all_edges = tree.unionByName(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    ordered = F.coalesce(a <= b, a.isNull())  # null is before all others
    pairs = all_edges.select(F.when(ordered, a).otherwise(b).alias("a"), F.when(ordered, b).otherwise(a).alias("b")).distinct()
    there, back = F.struct(a.alias("source"), b.alias("target")), F.struct(b.alias("source"), a.alias("target"))
    ways = F.when(a.eqNullSafe(b), F.array(there)).otherwise(F.array(there, back))
    return pairs.select(F.explode(ways).alias("e")).select("e.*")


def _digits(text: Column, n: int) -> Column:
    """The first ``n`` hexadecimal digits of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def _draw(seed: int, step: int, *columns: str) -> Column:
    """A uniform number in (0, 1) that depends on seed, step and columns alone."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(step)), *[F.col(c).cast("string") for c in columns])
    return (_digits(text, 13) + 0.5) / float(1 << 52)


def walk(starts: DataFrame, neighbours: DataFrame, steps: int, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """(walk, step, node): from each start (walk, node) up to ``steps`` steps to random neighbours (source, target).

    Neighbours are numbered once, or laid out by ``weight`` once, and a step draws a number, so it is one row per walk
    even at a node of very many neighbours. Each step is written and the next reads it, so a walk of k steps is k joins
    with the neighbours. Equal seeds give equal walks.
    """
    here = starts.select("walk", F.lit(0).alias("step"), "node")
    folder = scratch_path(starts.sparkSession, "walk")
    paths = [f"{folder}/0"]
    here.write.parquet(paths[0])
    read = lambda *chosen: starts.sparkSession.read.schema(here.schema).parquet(*chosen)
    if weight is None:
        laid = written(numbered_neighbours(neighbours), "neighbours")
        sources = laid.filter("number = 0").select(F.col("source").alias("node"), "degree")
    else:
        laid = written(weighted_neighbours(neighbours.select("source", "target", weight.alias("weight"))), "neighbours")
        sources = laid.filter("low = 0 AND cell = 0").select(F.col("source").alias("node"), "total", "width")  # one row a source
    for step in range(1, steps + 1):
        at = read(paths[-1]).join(sources, "node")
        drawn = _draw(seed, step, "walk", "node")
        if weight is None:
            chosen = at.select("walk", F.col("node").alias("source"), F.floor(drawn * F.col("degree")).alias("number"))
            further = chosen.join(laid, ["source", "number"])
        else:
            point = F.least(F.floor(drawn * F.col("total")), F.col("total") - 1)
            chosen = at.select("walk", F.col("node").alias("source"), point.alias("point"), F.floor(point / F.col("width")).alias("cell"))
            further = chosen.join(laid, ["source", "cell"]).filter("point >= low AND point < high")
        paths.append(f"{folder}/{step}")
        further.select("walk", F.lit(step).alias("step"), F.col("target").alias("node")).write.parquet(paths[-1])
    return read(*paths)


#: Weights are whole numbers of this part, so that their sums are exact in any order.
WEIGHT_UNIT = 1_000_000


def weighted_neighbours(neighbours: DataFrame) -> DataFrame:
    """``neighbours`` (source, target, weight) as a table to draw from: source, target, low, high, total, width, cell.

    A neighbour owns the whole numbers from ``low`` to below ``high`` of its source's ``total``, which running sums lay
    out. They are cut into as many cells of ``width`` as the source has neighbours, and a neighbour has a row for
    each cell that it reaches into: two rows a neighbour on average. So a drawn number finds its neighbour by an
    equality join on the cell, even at a hub. Weights under a WEIGHT_UNIT-th count as that.
    """
    whole = F.greatest(F.round(F.col("weight") * WEIGHT_UNIT), F.lit(1)).cast("long")
    few, many, tasks = _by_hubs(neighbours.select("source", "target", whole.alias("share")))
    by_target = Window.partitionBy("source").orderBy("target")
    along, whole_source = (by_target.rowsBetween(Window.unboundedPreceding, end) for end in (0, Window.unboundedFollowing))
    rows = few.repartition(tasks, "source").groupBy("source", "target").agg(F.sum("share").alias("share"))
    rows = rows.select(
        "*", F.sum("share").over(along).alias("high"), F.sum("share").over(whole_source).alias("total"),
        F.count("*").over(whole_source).alias("degree"),
    )
    if many is not None:  # the neighbours of a hub don't meet
        shares = running_sum(many.groupBy("source", "target").agg(F.sum("share").alias("share")), ["source"], "target", "share", "high")
        totals = shares.groupBy(F.col("source").alias("of")).agg(F.max("high").alias("total"), F.count("*").alias("degree"))
        rows = rows.unionByName(shares.join(F.broadcast(totals), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    rows = rows.withColumns({"low": F.col("high") - F.col("share"), "width": F.ceil(F.col("total") / F.col("degree"))})
    first, last = F.floor(F.col("low") / F.col("width")), F.floor((F.col("high") - 1) / F.col("width"))
    return rows.select("source", "target", "low", "high", "total", "width", F.explode(F.sequence(first, last)).alias("cell"))


def numbered_neighbours(neighbours: DataFrame) -> DataFrame:
    """``neighbours`` (source, target) with ``number``, from 0 within the source, and ``degree``.

    The neighbours of a source meet once, where they are told apart and numbered. Those of a hub are numbered in PARTS
    parts after one another, so they don't meet in one task.
    """
    few, many, tasks = _by_hubs(neighbours.select("source", "target"))
    part = F.coalesce(_digits(F.col("target").cast("string"), 4) % PARTS, F.lit(PARTS))
    along = Window.partitionBy("source").orderBy("part", "target")
    number = (F.row_number().over(along) - 1).cast("long")
    degree = F.count("*").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # same order: one window
    rows = few.repartition(tasks, "source").distinct().withColumn("part", part)
    placed = rows.select("source", "target", number.alias("number"), degree.alias("degree"))
    return placed if many is None else placed.unionByName(_numbered_in_parts(many.distinct().withColumn("part", part)))


def _by_hubs(neighbours: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """``neighbours`` of sources with up to HUB_ROWS rows, those of hubs, None if there are none, and tasks for the rows.

    There is a hub per HUB_ROWS rows at most, so their names are broadcast.
    """
    counts = neighbours.groupBy("source").agg(F.count("*").alias("n"))
    rows, most = counts.agg(F.sum("n"), F.max("n")).first()
    tasks = tasks_for(neighbours.sparkSession, rows)
    if (most or 0) <= HUB_ROWS:
        return neighbours, None, tasks
    hubs = F.broadcast(written(counts.filter(F.col("n") > HUB_ROWS).select(F.col("source").alias("hub")), "hubs"))
    at_hub = F.col("source").eqNullSafe(F.col("hub"))
    return neighbours.join(hubs, at_hub, "left_anti"), neighbours.join(hubs, at_hub, "left_semi"), tasks


def _numbered_in_parts(parted: DataFrame) -> DataFrame:
    """Distinct (source, target, part) of hubs with number and degree, see :func:`numbered_neighbours`."""
    counts = parted.groupBy(F.col("source").alias("of"), F.col("part").alias("of_part")).agg(F.count("*").alias("n"))
    of_source = Window.partitionBy("of")
    before = of_source.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "of", "of_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(of_source).alias("degree")
    )
    inside = Window.partitionBy("source", "part").orderBy("target")
    placed = parted.withColumn("row", F.row_number().over(inside))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return placed.select("source", "target", (F.col("start") + F.col("row") - 1).alias("number"), "degree")


def weighted_targets(perspectives: DataFrame, agent: str, context: str | None = None, least: float = 0.0) -> DataFrame:
    """(node_id, weight): what an agent rates above ``least``, the start of a walk over its perspectives."""
    mine = perspectives.filter((F.col("agent_id") == agent) & (F.col("weight") > least))
    if context is not None:
        mine = mine.filter(F.col("context_id") == context)
    return mine.groupBy("node_id").agg(F.max("weight").alias("weight"))


def perspective_walk(perspectives: DataFrame, agent: str, length: int, seed: int = 0) -> DataFrame:
    """(step, id): up to ``length`` nodes that an agent rates above zero, drawn without repeats by their weights."""
    rated = weighted_targets(perspectives, agent)
    drawn = -F.log(_draw(seed, 0, "node_id")) / F.col("weight")
    first = rated.select(F.col("node_id").alias("id"), drawn.alias("drawn")).orderBy("drawn", "id").limit(length)
    return first.select((F.row_number().over(Window.orderBy("drawn", "id")) - 1).alias("step"), "id")


#: The least weight of an edge in walks by perspectives.
LEAST_WEIGHT = 0.01


def perspective_edges(edges: DataFrame, perspectives: DataFrame, agent: str) -> DataFrame:
    """(source, target, weight) of ``edges``: 1 plus the size of what the agent rates the target, LEAST_WEIGHT at least.

    A target that the agent rates in several contexts counts once for each, an unrated one weighs 1.
    """
    rated = perspectives.filter(F.col("agent_id") == agent).select(F.col("node_id").alias("target"), F.col("weight").alias("rated"))
    ends = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    weight = F.greatest(1 + F.abs(F.coalesce("rated", F.lit(0.0))), F.lit(LEAST_WEIGHT))
    return ends.join(rated, "target", "left").select("source", "target", weight.alias("weight"))


def drawn_starts(neighbours: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(walk, node): ``n`` starts, drawn with repeats from the sources of ``neighbours``."""
    sources = neighbours.select("source").distinct().withColumn("one", F.lit(1).cast("long"))
    numbered = written(running_sum(sources, [], "source", "one", "number"), "walk-starts")
    total = numbered.count()
    walks = neighbours.sparkSession.range(n).withColumnRenamed("id", "walk")
    drawn = walks.select("walk", (F.floor(_draw(seed, 0, "walk") * total) + 1).alias("number"))
    return drawn.join(numbered, "number").select("walk", F.col("source").alias("node"))


WALKS = ("edge", "random", "perspective")


def generated(
    kind: str, nodes: DataFrame, edges: DataFrame, n: int, length: int, seed: int = 0, perspectives: DataFrame | None = None, agent: str = ""
) -> DataFrame:
    """(walk, step, node): ``n`` training sequences of a kind of WALKS, of up to ``length`` nodes; those of one are left out.

    ``edge`` goes along edges, ``random`` along edges and the tree in both directions, ``perspective`` along edges by
    what an agent thinks of their ends. Without edges the first and last go from parents to children.
    """
    if kind not in WALKS:
        raise ValueError(f"a walk is one of {', '.join(WALKS)}")
    weight = None
    ends = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    if kind == "random":
        neighbours = adjacency(nodes, edges)
    elif not edges.limit(1).count():
        neighbours = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("source"), F.col("id").alias("target"))
    elif kind == "edge":
        neighbours = ends
    else:
        neighbours, weight = perspective_edges(edges, perspectives, agent), F.col("weight")
    out = walk(drawn_starts(neighbours, n, seed), neighbours, length - 1, seed, weight)
    longer = out.filter("step = 1").select("walk")
    return out.join(longer, "walk", "left_semi")


def tree_walk(nodes: DataFrame, root: str, length: int) -> DataFrame:
    """(step, id): the first ``length`` nodes below ``root`` in preorder: the order of their paths of positions."""
    below = nodes.filter((F.col("path") == root) | F.col("path").startswith(root + "."))
    first = below.orderBy("path", "position", "id").limit(length)
    return first.select((F.row_number().over(Window.orderBy("path", "position", "id")) - 1).alias("step"), "id")
