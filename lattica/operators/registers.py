"""Preferences, initial documents, workspaces, inferences and commits as tables; what changes them is appended to logs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lattica.operators.latest import sync_counts
from lattica.operators.navigate import _reached
from lattica.operators.requests import refused
from lattica.operators.running import ranked
from lattica.tables import written

# The sections of an initial document: category, heading, what stands between key and value.
SECTIONS = (("alias", "# aliases", ": "), ("config", "# config", " "))
EMPTY_DOCUMENT = "# empty — add aliases (name: target) and config (key value)\n"


# Preferences (category, key, value, updated_at), kept by lattica.operators.latest


def get_preference(preferences: DataFrame, category: str, key: str) -> DataFrame:
    return preferences.filter((F.col("category") == category) & (F.col("key") == key)).select("value")


def list_preferences(preferences: DataFrame, category: str) -> DataFrame:
    return preferences.filter(F.col("category") == category).select("key", "value", "updated_at").orderBy("key")


def export_preferences(preferences: DataFrame, category: str) -> DataFrame:
    """One row with the JSON array of a category's preferences, by key. It holds no more than one instance's settings."""
    rows = preferences.filter(F.col("category") == category).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("rows"))
    return rows.select(F.to_json("rows").alias("json"))


def init_document(preferences: DataFrame) -> DataFrame:
    """One row with the document of all aliases and settings, by key; it is what is pushed onto the stack."""
    parts = []
    for category, heading, between in SECTIONS:
        line = F.concat("key", F.lit(between), "value", F.lit("\n"))
        lines = F.array_sort(F.collect_list(F.when(F.col("category") == category, F.struct("key", line.alias("line")))))
        text = F.array_join(F.transform(lines, lambda x: x["line"]), "")
        parts.append(F.when(F.size(lines) > 0, F.concat(F.lit(heading + "\n"), text)))
    document = F.concat_ws("\n", *parts)
    return preferences.agg(F.when(document == "", EMPTY_DOCUMENT).otherwise(document).alias("document"))


def init_rows(documents: DataFrame) -> DataFrame:
    """(id, category, key, value) of initial documents (id, document): the last of a key's lines counts."""
    lines = documents.select("id", F.posexplode(F.split("document", "\n")).alias("line", "text"))
    heading = F.when(F.startswith("text", F.lit("#")), F.trim("text"))
    order = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # one document
    rows = lines.withColumn("section", F.last(heading, ignorenulls=True).over(order)).filter(heading.isNull())
    out = None
    for category, name, between in SECTIONS:
        own = rows.filter((F.col("section") == name) & F.contains("text", F.lit(between)))
        at = F.instr("text", between)
        found = own.select(
            "id", F.lit(category).alias("category"), F.trim(F.substring("text", F.lit(1), at - 1)).alias("key"),
            F.trim(F.substring("text", at + len(between), F.length("text"))).alias("value"), "line",
        )
        out = found if out is None else out.unionByName(found)
    return out.groupBy("id", "category", "key").agg(F.max_by("value", "line").alias("value"))


def push_counts(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """One row: how many preferences (key, value) a document adds, updates and deletes."""
    changes = sync_counts(wanted, current, "key", "value")
    return changes.agg(*[F.count_if(F.col("change") == c).alias(name) for c, name in (("add", "added"), ("update", "updated"), ("delete", "deleted"))])


# Workspaces


def typed(kind: Column, ref_id: Column, meta: Column) -> Column:
    """The content of a typed item, for a push onto a workspace's stack."""
    return F.struct(kind.alias("kind"), ref_id.alias("ref_id"), meta.alias("meta"))


def typed_list(items: DataFrame, workspace) -> DataFrame:
    """(position, kind, ref_id, meta) of a workspace's items (stack, position, content), top first."""
    own = items.filter(F.col("stack") == workspace)
    return own.select("position", "content.kind", "content.ref_id", "content.meta").orderBy(F.desc("position"))


def dropped(items: DataFrame, ids: DataFrame) -> DataFrame:
    """``items`` (id, ...) without those of ``ids`` (id)."""
    return items.join(ids.select("id").distinct(), "id", "left_anti")


def duplicated(items: DataFrame, requests: DataFrame) -> DataFrame:
    """``items`` (id, stack, position, content) and the copies that requests (seq, id, stack) make on top of stacks.

    A copy's id is the request's number after the largest id; requests of unknown items make none.
    """
    last = items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    tops = items.groupBy("stack").agg(F.max("position").alias("top"))
    wanted = requests.select("seq", "id", F.col("stack").alias("onto")).join(items.select("id", "content"), "id")
    wanted = wanted.join(tops.withColumnRenamed("stack", "onto"), "onto", "left")
    place = F.row_number().over(Window.partitionBy("onto").orderBy("seq"))  # the requests of one workspace
    copies = wanted.select(
        (F.col("seq") + last + 1).alias("id"), F.col("onto").alias("stack"),
        (F.coalesce("top", F.lit(0)) + place).cast(items.schema["position"].dataType).alias("position"), "content",
    )
    return items.unionByName(copies)


def create_workspaces(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (seq, user_id, name) with the id of the new workspace; unknown users are refused."""
    known = users.select("user_id").distinct().withColumn("known", F.lit(True))
    rows = requests.join(known, "user_id", "left")
    rows = rows.withColumn("refused", refused(("user", F.col("known").isNull()))).drop("known")
    return rows.withColumn("id", F.when(F.col("refused").isNull(), F.sha2(F.concat_ws("|", "user_id", "name", "seq"), 256)))


def anonymous(sessions: DataFrame) -> DataFrame:
    """(user_id, workspace_id) of sessions (session) without a user: equal sessions get the same, once."""
    one = sessions.select("session").distinct()
    return one.select(
        F.sha2(F.concat(F.lit("user|"), "session"), 256).alias("user_id"), F.sha2(F.concat(F.lit("workspace|"), "session"), 256).alias("workspace_id")
    )


def bootstrapped(instances: DataFrame, wallets: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows (instance; wallet) that are missing of the instance itself: none where they are there already."""
    spark = instances.sparkSession
    me = spark.range(1).select(F.lit(name).alias("name"), F.lit(True).alias("is_self"))
    new = me.join(instances.filter("is_self").select("is_self"), "is_self", "left_anti").select("name", "is_self")
    wallet = spark.range(1).select(F.lit(name).alias("instance"), F.lit("instance").alias("wallet_type"))
    held = wallets.filter("wallet_type = 'instance'").select(F.col("instance"))
    return new, wallet.join(held, "instance", "left_anti")


# Models


def create_models(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """Requests (seq, agent, dim, n_heads): the dimension must be a multiple of the heads."""
    known = agents.select(F.col("name").alias("agent")).distinct().withColumn("known", F.lit(True))
    rows = requests.join(known, "agent", "left")
    bad = (F.col("dim") <= 0) | (F.col("n_heads") <= 0) | (F.try_mod("dim", "n_heads") != 0)
    return rows.withColumn("refused", refused(("agent", F.col("known").isNull()), ("dim", bad))).drop("known")


def with_selections(inferences: DataFrame, selections: DataFrame) -> DataFrame:
    """``inferences`` (id, ...) with ``selected``: whether a selection (inference_id) names them."""
    named = selections.select(F.col("inference_id").alias("id")).distinct().withColumn("selected", F.lit(True))
    return inferences.join(named, "id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


# Commits (repo, sha, parents, message, time)


def list_repos(repos: DataFrame) -> DataFrame:
    return repos.orderBy(F.desc("created_at"), "name")


def commit_nodes(commits: DataFrame) -> DataFrame:
    """(id, kind, content, parent_id, metadata): a node per commit below its repository."""
    meta = F.to_json(F.struct("sha", "time"))
    return commits.select(
        F.concat_ws("@", "repo", "sha").alias("id"), F.lit("repo_commit").alias("kind"), F.col("message").alias("content"),
        F.col("repo").alias("parent_id"), meta.alias("metadata"),
    )


def commit_edges(commits: DataFrame) -> DataFrame:
    """(source_id, target_id, relation): from each commit to its parents that are there."""
    pairs = commits.select("repo", F.concat_ws("@", "repo", "sha").alias("source_id"), F.explode("parents").alias("parent"))
    ends = pairs.select("source_id", F.concat_ws("@", "repo", "parent").alias("target_id"), F.lit("parent_commit").alias("relation"))
    there = commits.select(F.concat_ws("@", "repo", "sha").alias("target_id"))
    return ends.join(there, "target_id", "left_semi").select("source_id", "target_id", "relation").distinct()


def reachable_commits(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """``commits`` that the commits of ``refs`` (repo, sha) reach: what a mirror at these holds."""
    links = commit_edges(commits).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    start = refs.select(F.concat_ws("@", "repo", "sha").alias("id"))
    found = _reached(links, start).select(F.col("id").alias("found"))
    return commits.join(found, F.concat_ws("@", "repo", "sha") == F.col("found"), "left_semi")


RING = "commits are each other's parents"


#: A block holds the commits whose numbers are alike but for their last 16 bits.
BLOCK_BITS = 16
#: The time of a commit without one: before all others.
NEVER = -(1 << 62)


def _numbered_commits(commits: DataFrame) -> DataFrame:
    """(id, repo, sha, time, parents, at, number) of commits: numbers go by repository and time, so parents are often near.

    ``at`` is the time as a number that is never null.
    """
    kind = "long" if isinstance(commits.schema["time"].dataType, IntegralType) else "double"
    rows = commits.select(F.concat_ws("@", "repo", "sha").alias("id"), "repo", "sha", "time", "parents")
    rows = rows.withColumn("at", F.coalesce(F.col("time").cast(kind), F.lit(NEVER).cast(kind)))
    order = ("repo", "time", "sha")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumn("number", F.monotonically_increasing_id()), "commit-rows")


def _commit_pairs(rows: DataFrame) -> DataFrame:
    """(role, number, at, alone, target, target_at, single) from one shuffle of commits and of the parents that they name.

    Role edge: commit ``number`` has parent ``target``, which is all that it names (alone) and whose only child it is
    (single). Role fork: a commit that may have a child which isn't the only one or has other parents. Role copy: a
    commit that is there already.
    """
    named = F.array_distinct(F.transform(F.array_compact("parents"), lambda p: F.concat_ws("@", "repo", p)))
    rows = rows.withColumn("named", F.array_remove(named, F.col("id")))
    asked = rows.select(F.explode("named").alias("id"), "number", "at", (F.size("named") == 1).alias("alone"))
    met = rows.select("id", "number", "at", F.lit(None).cast("boolean").alias("alone")).unionByName(asked)
    own, one = F.col("alone").isNull(), Window.partitionBy("id")
    met = met.withColumns({
        "target": F.min(F.when(own, F.col("number"))).over(one), "target_at": F.max(F.when(own, F.col("at"))).over(one),
        "children": F.count("alone").over(one), "sure": F.bool_or("alone").over(one),
    })
    fork = (F.col("children") > 1) | ((F.col("children") == 1) & ~F.col("sure"))
    role = F.when(~own, "edge").when(F.col("number") != F.col("target"), "copy").when(fork, "fork")
    met = met.filter(F.col("target").isNotNull()).withColumn("role", role).filter(F.col("role").isNotNull())
    return written(met.select("role", "number", "at", "alone", "target", "target_at", (F.col("children") == 1).alias("single")), "commit-pairs")


def _block(number: str) -> Column:
    return F.shiftright(number, BLOCK_BITS)


def _hopped(rows: pd.DataFrame) -> pd.DataFrame:
    """Hops of a block's commits (number, least, target; target -1: a fork) as far down their runs as the block goes."""
    inner = rows[rows["target"] >= 0].sort_values("number")
    ids, up, least = inner["number"].to_numpy(), inner["target"].to_numpy().copy(), inner["least"].to_numpy().copy()
    steps = np.ones(len(ids), dtype=np.int64)
    via = np.searchsorted(ids, up)
    via[via == len(ids)] = 0
    via = np.where(ids[via] == up, via, -1) if len(ids) else via
    for _ in range(len(ids).bit_length() + 1):
        go = np.flatnonzero(via >= 0)
        if not len(go):
            break
        to = via[go]
        least[go], steps[go], up[go], via[go] = np.maximum(least[go], least[to] + steps[go]), steps[go] + steps[to], up[to], via[to]
    forks = rows.loc[rows["target"] < 0, "number"]
    return pd.DataFrame({"id": ids, "up": up, "steps": steps, "least": least, "ring": via >= 0, "fork": np.isin(ids, forks)})


def _combined(hops: DataFrame, over: DataFrame, *more: Column) -> DataFrame:
    """``hops`` that go on by the hops of ``over`` which begin where they end; without any they stay."""
    over = over.select(F.col("id").alias("via"), F.col("up").alias("further"), *[F.col(c).alias(f"over_{c}") for c in over.columns[2:]])
    steps = F.col("steps") + F.coalesce("over_steps", F.lit(0))
    least = F.greatest("least", F.col("over_least") + F.col("steps"))
    joined = hops.join(over, F.col("up") == F.col("via"), "left")
    return joined.select("id", F.coalesce("further", "up").alias("up"), steps.alias("steps"), least.alias("least"), *more)


def commit_hops(inner: DataFrame, forks: DataFrame) -> DataFrame:
    """(id, up, steps, least, fork): each commit of ``inner`` (number, least, target) with the first commit of its run.

    In a run each commit is the only child of its only parent. A commit's moment is ``least``, or ``steps`` more than that
    of ``up`` if this is later; ``fork`` tells whether the commit is one of ``forks`` (number). Runs are followed within
    blocks of numbers, a block in a task. What leaves a block goes on by bridges, the hops that start where another block's
    end; in every round these double, so a run takes the logarithm of its blocks in rounds.
    """
    kind = inner.schema["least"].dataType.simpleString()
    rows = inner.unionByName(forks.select("number", F.lit(0).cast(kind).alias("least"), F.lit(-1).cast("long").alias("target")))
    schema = f"id long, up long, steps long, least {kind}, ring boolean, fork boolean"
    hops = written(rows.groupBy(_block("number").alias("block")).applyInPandas(_hopped, schema), "commit-hops")
    if hops.filter("ring").limit(1).count():
        raise ValueError(RING)
    met = written(hops.filter(_block("id") != _block("up")).select(F.col("up").alias("id")).distinct(), "commit-met")
    bridges = written(hops.join(met, "id").select("id", "up", "steps", "least"), "commit-bridges")
    there = bridges.select(F.col("id").alias("there"))
    ends = F.col("there").isNull().alias("ends")
    bridges = written(bridges.join(there, F.col("up") == F.col("there"), "left").select(*bridges.columns, ends), "commit-bridges")
    rounds = bridges.count().bit_length() + 1
    while bridges.filter("NOT ends").limit(1).count():
        if not rounds:
            raise ValueError(RING)
        rounds -= 1
        moved = _combined(bridges.filter("NOT ends"), bridges, F.col("over_ends").alias("ends"))
        bridges = written(bridges.filter("ends").unionByName(moved), "commit-bridges")
    return _combined(hops, bridges.drop("ends"), F.col("fork"))


def _pushed(links: DataFrame) -> DataFrame:
    """(id, pushed) of the first commits of runs that their parents leave a later moment than their own time.

    ``links`` (run, at, of, steps, least): a first commit comes after ``least`` and ``steps`` after the commit ``of``. A round
    passes on what the last one changed.
    """
    later = links.groupBy("run").agg(F.max("least").alias("pushed"), F.max("at").alias("at"))
    changed = written(later.filter("pushed > at").select(F.col("run").alias("id"), "pushed"), "commit-pushed")
    known, rounds = [changed], links.select("run").distinct().count() + 1
    while True:
        after = F.col("steps") + F.col("pushed")
        through = links.join(changed, F.col("of") == F.col("id")).filter(after > F.greatest("least", "at"))
        further = through.groupBy("run").agg(F.max(after).alias("further"))
        changed = further.join(_latest(known), F.col("run") == F.col("id"), "left").filter("pushed IS NULL OR further > pushed")
        changed = written(changed.select(F.col("run").alias("id"), F.col("further").alias("pushed")), "commit-pushed")
        if not changed.limit(1).count():
            return _latest(known)
        if not rounds:
            raise ValueError(RING)
        rounds -= 1
        known.append(changed)
        if len(known) > 8:
            known = [written(_latest(known), "commit-pushed")]


def _latest(known: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, known).groupBy("id").agg(F.max("pushed").alias("pushed"))


def commit_order(commits: DataFrame) -> DataFrame:
    """(repo, sha, moment, place): parents before children, else by time; ``place`` counts from 0 in the repository.

    A commit's ``moment`` is its time, or one more than the latest moment of its parents if that is later. Along a run
    of commits it follows from the run's first commit, and between runs moments are passed on until none changes: as many
    rounds as runs follow each other with times that lie behind, and one more. A commit that names itself as a parent doesn't
    count as one; longer rings, which hashes can't form, are an error. Commits are told apart by numbers after one shuffle.
    Rows of one commit have one moment, after the latest of their times and all their parents.
    """
    rows = _numbered_commits(commits)
    pairs = _commit_pairs(rows)
    if pairs.filter("role = 'copy'").limit(1).count():
        once = rows.groupBy("id").agg(
            F.min("repo").alias("repo"), F.min("sha").alias("sha"), F.max("time").alias("time"), F.flatten(F.collect_list("parents")).alias("parents")
        )
        once = _numbered_commits(once)
        moments = once.select("id", "number").join(_moments(_commit_pairs(once)), "number").select("id", "later")
        timed = rows.drop("at").join(once.select("id", "at").join(moments, "id", "left"), "id")
    else:
        timed = rows.join(_moments(pairs), "number", "left")
    moment = F.coalesce("later", "at")
    timed = timed.select("repo", "sha", F.when(moment > NEVER // 2, moment).alias("moment"), "time")
    return ranked(timed, ["repo"], ["moment", "time", "sha"], "place").drop("time")


def _moments(pairs: DataFrame) -> DataFrame:
    """(number, later) of the commits of ``pairs`` that have parents: their moments, unless they are their own times."""
    edges, single = pairs.filter("role = 'edge'"), F.col("single")
    several = edges.filter("NOT alone").withColumn("alone", F.count("*").over(Window.partitionBy("number")) == 1)
    edges = edges.filter("alone").unionByName(several)
    inner, outer = edges.filter(F.col("alone") & single), edges.filter(~(F.col("alone") & single))
    least = F.greatest("at", F.col("target_at") + 1)
    hops = commit_hops(inner.select("number", least.alias("least"), "target"), pairs.filter("role = 'fork'"))
    onto = hops.filter("fork").select(F.col("id").alias("target"), "up", "steps", F.col("least").alias("there"))
    links = outer.join(onto, "target", "left").select(
        F.col("number").alias("run"), "at", F.coalesce("up", "target").alias("of"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"),
        (F.coalesce("there", "target_at") + 1).alias("least"),
    )
    pushed = _pushed(written(links, "commit-links"))
    along = hops.join(pushed.withColumnRenamed("id", "first"), F.col("up") == F.col("first"), "left")
    moved = along.select(F.col("id").alias("number"), F.greatest("least", F.col("pushed") + F.col("steps")).alias("later"))
    return moved.unionByName(pushed.select(F.col("id").alias("number"), F.col("pushed").alias("later")))
