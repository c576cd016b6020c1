"""Chat formatting over reply trees: paths from root to leaf by iterative self-joins, ranked, and formatted.

Each round joins the table of pointers to ancestors with itself, so that pointers
double in length and scores are summed to the root: a tree of depth d takes
log2(d) + 1 rounds, each written to the shared folder as one thin row a node. The
best leaves are then known, and only for them the pointers, longest first, give the
nodes of their paths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import col, materialize

TOP_BRANCHES = 3


def reply_nodes(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, node, parent, role, text, score) of a log of turns without parents.

    Nodes are numbered from 0 by turn, role and text (nulls first). A turn
    answers the last turn of the nearest earlier run of another role; turns of
    one run are alternative answers to the same parent. Fully equal rows are one
    node. Turns are numbered in sorted partitions, so that no task holds a whole
    conversation. Rows with a null conversation or turn have no place and are left out;
    a null role counts as a role of its own and prints as ``unknown``; a null
    text is empty. The score is the length of an assistant's text, else 0.
    """
    rows = turns.select(col(conv_col).alias("conv"), col(turn_col).alias("turn"), col(role_col).alias("role"), col(text_col).alias("text"))
    rows = rows.where("conv is not null and turn is not null").select("conv", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    kind = rows.schema["conv"].dataType.simpleString()
    rows = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    at = rows.select(F.spark_partition_id().alias("part"), "conv", "role", "text").mapInArrow(_number, f"part int, conv {kind}, role string, text string, place bigint, before bigint")
    at = materialize(at, "numbered")
    # a conversation over several partitions: at most two of a partition, its first and its last, reach beyond it
    ends = at.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min_by("role", "place").alias("first"), F.max_by("role", "place").alias("last"), F.max_by("before", "place").alias("answers"))
    over = ends.join(ends.groupBy("conv").count().where("count > 1").select("conv"), "conv", "left_semi")
    w = "(PARTITION BY conv ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    over = over.selectExpr("*", f"coalesce(sum(n) OVER {w}, 0) AS offset", "lag(last) OVER (PARTITION BY conv ORDER BY part) AS role_before")
    over = over.selectExpr("*", "CASE WHEN role_before <> first THEN offset - 1 END AS opens").selectExpr("*", "coalesce(offset + answers, opens) AS told")
    over = materialize(over.selectExpr("conv AS c", "part AS p", "offset", f"coalesce(opens, last_value(told, true) OVER {w}) AS open"), "crossings")
    rows = at.join(F.broadcast(over), (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")), "left")  # two rows a partition
    return rows.selectExpr(
        "conv", "coalesce(offset, 0) + place AS node", "coalesce(coalesce(offset, 0) + before, open) AS parent", "role", "text",
        "cast(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END as bigint) AS score",
    )


def _number(batches):
    """Sorted turns of one partition with their place in its part of the conversation, and the last place of the nearest earlier run of another role there."""
    conv = role = None
    n, answers = 0, -1
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        c, r = batch.column(1), batch.column(2)
        new, other = np.ones(m, bool), np.ones(m, bool)
        new[0], other[0] = c[0].as_py() != conv, r[0].as_py() != role
        if m > 1:
            new[1:], other[1:] = (pc.not_equal(x.slice(1), x.slice(0, m - 1)).to_numpy(zero_copy_only=False) for x in (c, r))
        row = np.arange(m)
        start = np.maximum.accumulate(np.where(new, row, -1))  # -1: begun in an earlier batch
        place = np.where(start >= 0, row - start, row + n)
        changed = np.maximum.accumulate(np.where(other & ~new, row, -1))
        before = np.where((changed >= start) & (changed >= 0), place[changed] - 1, np.where(start >= 0, -1, answers))
        conv, role, n, answers = c[m - 1].as_py(), r[m - 1].as_py(), int(place[-1]) + 1, int(before[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(before, mask=before < 0)], ["part", "conv", "role", "text", "place", "before"])


def pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables (conv, node, up) of ancestors at distance 1, 2, 4, ..., and (conv, leaf, score) of the leaves that have a root.

    A parent that doesn't exist makes a root. Nodes on or below a cycle have no root.
    """
    thin = nodes.select("conv", "node", "parent", F.coalesce("score", F.lit(0)).alias("score"))
    known = thin.select(F.col("conv").alias("c"), F.col("node").alias("p"))
    at = thin.join(known, (F.col("conv") == F.col("c")) & (F.col("parent") == F.col("p")), "left")
    # the score of a node's path as far as its pointer, which is not included
    at = materialize(at.select("conv", "node", F.col("p").alias("up"), "score"), "pointers")
    most = at.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    tables, reach = [], 1
    while reach <= most and not at.where("up is not null").isEmpty():
        tables.append(at.select("conv", "node", "up"))
        above = at.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("score").alias("more"))
        at = at.join(above, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("n")), "left")
        at = materialize(at.select("conv", "node", F.col("next").alias("up"), (F.col("score") + F.coalesce("more", F.lit(0))).alias("score")), "pointers")
        reach *= 2
    parents = thin.where("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    leaves = at.where("up is null").join(parents, ["conv", "node"], "left_anti")
    return tables, leaves.select("conv", F.col("node").alias("leaf"), "score")


def steps(leaves: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(conv, leaf, node, back) for every node of the paths to the given (conv, leaf), ``back`` steps above the leaf."""
    at = leaves.select("conv", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("back"))
    for k in range(len(tables) - 1, -1, -1):
        jump = tables[k].where("up is not null").select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        both = at.join(jump, (F.col("conv") == F.col("c")) & (F.col("node") == F.col("n")), "left")
        here, there = F.struct("node", "back"), F.struct(F.col("up").alias("node"), (F.col("back") + 2**k).alias("back"))
        at = both.select("conv", "leaf", F.explode(F.array_compact(F.array(here, F.when(F.col("up").isNotNull(), there)))).alias("s"))
        at = at.select("conv", "leaf", F.col("s.node").alias("node"), F.col("s.back").alias("back"))
    return at


def branches(nodes: DataFrame) -> DataFrame:
    """(conv, leaf, path, score) of each leaf of (conv, node, parent, score): path from the root, summed score."""
    tables, leaves = pointers(nodes)
    path = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "node")))
    paths = steps(leaves, tables).groupBy("conv", "leaf").agg(F.transform(path, lambda p: p["node"]).alias("path"))
    return paths.join(leaves, ["conv", "leaf"]).select("conv", "leaf", "path", "score")


def format_branches(nodes: DataFrame, *, top: int = TOP_BRANCHES) -> DataFrame:
    """(conv_id, branch, leaf, n_turns, score, text): the ``top`` branches of each tree by score, ties to the lesser leaf."""
    tables, leaves = pointers(nodes)
    best = leaves.selectExpr("*", "row_number() OVER (PARTITION BY conv ORDER BY score DESC, leaf) AS branch").where(F.col("branch") <= top)
    best = materialize(best, "best-branches")
    line = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    turns = steps(best, tables).join(nodes.select("conv", "node", line.alias("line")), ["conv", "node"])
    out = turns.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "line"))).alias("t"))
    return out.join(best, ["conv", "leaf"]).select(
        F.col("conv").alias("conv_id"), F.col("branch").cast("bigint").alias("branch"), "leaf", F.size("t").cast("bigint").alias("n_turns"),
        "score", F.array_join(F.transform("t", lambda t: t["line"]), "").alias("text"),
    )


def reply_trees(turns: DataFrame, *, top: int = TOP_BRANCHES) -> DataFrame:
    """The best branches of every conversation of a log of turns, each formatted as one conversation.

    (conv_id, branch, leaf, n_turns, score, text); ``top`` branches a conversation,
    best first. Rows with a null conversation or turn are left out, a null role is
    ``unknown``, a null text empty, fully equal rows are one turn, equal scores go to
    the lesser leaf, other columns play no part. A text of any length stays whole. An
    empty table gives an empty table.
    """
    return format_branches(reply_nodes(turns), top=top)


REPLY_SQL = f"""
    WITH RECURSIVE rows_ AS (
        SELECT DISTINCT conv_id AS conv, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
    ), numbered AS (
        SELECT *, row_number() OVER w - 1 AS node, lag(role) OVER w AS before FROM rows_
        WINDOW w AS (PARTITION BY conv ORDER BY turn, role, text)
    ), nodes AS (
        SELECT conv, node, role, text, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS score,
               last_value(CASE WHEN before <> role THEN node - 1 END IGNORE NULLS)
                   OVER (PARTITION BY conv ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent
        FROM numbered
    ), walk AS (
        SELECT conv, node, 1 AS n_turns, score::BIGINT AS score,
               '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS text
        FROM nodes WHERE parent IS NULL
        UNION ALL
        SELECT n.conv, n.node, w.n_turns + 1, w.score + n.score,
               w.text || '<|im_start|>' || n.role || chr(10) || n.text || '<|im_end|>' || chr(10)
        FROM walk w JOIN nodes n ON n.conv = w.conv AND n.parent = w.node
    )
    SELECT conv AS conv_id, branch, leaf, n_turns, score, text FROM (
        SELECT conv, node AS leaf, n_turns::BIGINT AS n_turns, score, text,
               row_number() OVER (PARTITION BY conv ORDER BY score DESC, node) AS branch
        FROM walk w WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.conv = w.conv AND n.parent = w.node)
    ) WHERE branch <= {TOP_BRANCHES}
"""
