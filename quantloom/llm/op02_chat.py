"""Op 2, chat formatting over reply trees, in DataFrame functions only.

A message has a parent; a conversation is a tree.  Iterative self-joins double the distance they look up the tree, so
that after log2(depth) joins every message has the score of its whole path from the root.  Leaves are ranked by it, and only the best
branches (root-to-leaf paths) are expanded, by the same doubled jumps, and formatted, each as one conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import written


@dataclass(frozen=True)
class Template:
    """A turn is ``<s>[INST] role [/INST]`` newline, text, ``</s>`` newline.

    Inside roles and texts a backslash goes in after the first character of whatever reads as a mark, with any
    backslashes already there: ``</s>`` becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``. Taking one away reads it back.
    """

    before: str = "<s>[INST] "
    between: str = " [/INST]\n"
    after: str = "</s>\n"

    def escape(self, c: Column) -> Column:
        return F.regexp_replace(c, r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, r"([<\[])\\(\\*)(/?(?:s>|INST\]))", "$1$2$3")


def _uncircled(nodes: DataFrame, jump: DataFrame) -> DataFrame:
    """nodes with the parent of each circle's smallest node taken away. jump: what still leads on after more steps than a conversation has messages: it ends on circles.

    Along a circle the smallest node is found as far paths are: by steps that double.
    """
    on = written(jump.select("conv_id", F.col("to").alias("node")).distinct(), "circles")
    step = on.join(nodes, ["conv_id", "node"]).select("conv_id", "node", F.col("parent").alias("to"), F.col("node").alias("low"))
    reach, longest = 1, on.groupBy("conv_id").count().agg(F.max("count").alias("n")).first()["n"]
    while reach < longest:
        far = step.select("conv_id", F.col("node").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        step = written(step.join(far, ["conv_id", "to"]).select("conv_id", "node", F.col("far").alias("to"), F.least("low", "far_low").alias("low")), "circle-steps")
        reach *= 2
    heads = step.where("node = low").select("conv_id", "node", F.lit(True).alias("head"))
    return written(nodes.join(heads, ["conv_id", "node"], "left").withColumn("parent", F.when(F.col("head").isNull(), F.col("parent"))).drop("head"), "nodes")


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, path (rank of the branch), depth_from_root (0, 1, ...), role, text of the `top` best branches of each tree.

    messages: conv_id, node, parent (null, or no node of the conversation: a root), role, text, score. A branch's score is the sum of its
    messages' scores (null: 0); ties go to the smaller leaf. node is unique in a conversation: of repeated ones the least (parent, role, text) is taken. Of messages whose
    parents run in a circle the one with the smallest node is a root. Rows without a node are left out. Messages whose conv_id is null are one conversation.
    """
    # in a struct, which is never null itself, a null conv_id equals a null one in the joins
    key = F.struct(F.col("conv_id").alias("id"))
    said = F.struct(F.col("parent").isNotNull().alias("a"), "parent", F.coalesce("role", F.lit("")).alias("b"), F.coalesce("text", F.lit("")).alias("c"), F.coalesce("score", F.lit(0.0)).alias("score"), "role", "text")
    one = messages.where("node IS NOT NULL").groupBy(key.alias("conv_id"), "node").agg(F.min(said).alias("x"))
    messages = written(one.select("conv_id", "node", "x.parent", "x.role", "x.text", "x.score"), "tree")
    nodes = messages.select("conv_id", "node", "parent", "score")
    longest = nodes.groupBy("conv_id").count().agg(F.max("count").alias("n")).first()["n"] or 0
    while True:
        known = nodes.select(F.col("conv_id").alias("same"), F.col("node").alias("to"))
        inside = nodes.join(known, (F.col("conv_id") == F.col("same")) & (F.col("parent") == F.col("to")), "left").select("conv_id", "node", "to", "score")
        # total: the scores from a message up to the one before `to`, which is null once the root has been counted; those that are done are only looked up
        first = written(inside.withColumnRenamed("score", "total"), "jumps")
        done, state, jumps, reach = first.where("to IS NULL"), first.where("to IS NOT NULL"), [], 1
        while reach <= longest and not state.isEmpty():
            jumps.append((reach, state.select("conv_id", "node", "to")))
            far = done.unionByName(state).select("conv_id", F.col("node").alias("to"), F.col("to").alias("far"), F.col("total").alias("more"))
            step = written(state.join(far, ["conv_id", "to"]).select("conv_id", "node", F.col("far").alias("to"), (F.col("total") + F.col("more")).alias("total")), "jumps")
            done, state = done.unionByName(step.where("to IS NULL")), step.where("to IS NOT NULL")
            reach *= 2
        if state.isEmpty():
            break
        nodes = _uncircled(nodes, state)
    inner = nodes.select("conv_id", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = done.join(inner, ["conv_id", "node"], "left_anti").select("conv_id", F.col("node").alias("leaf"), "total")
    w = Window.partitionBy("conv_id").orderBy(F.col("total").desc(), "leaf")
    chosen = leaves.withColumn("path", F.row_number().over(w)).where(F.col("path") <= top).select("conv_id", "path", F.col("leaf").alias("node"), F.lit(0).alias("up"))
    paths = written(chosen, "paths")
    # a path that is known `reach` steps far from its leaf gets as many again
    for step, jump in jumps:
        paths = written(paths.unionByName(paths.join(jump, ["conv_id", "node"]).select("conv_id", "path", F.col("to").alias("node"), (F.col("up") + step).alias("up"))), "paths")
    depth = F.max("up").over(Window.partitionBy("conv_id", "path"))
    return (
        paths.withColumn("depth_from_root", depth - F.col("up"))
        .join(messages.select("conv_id", "node", "role", "text"), ["conv_id", "node"])
        .select(F.col("conv_id.id").alias("conv_id"), "path", "depth_from_root", "role", "text")
    )


def format_conversations(turns: DataFrame, template: Template = Template(), trained: str = "assistant") -> DataFrame:
    """conv_id, path, formatted, loss: array of spans (start, length in code points, from 1) of the texts of role `trained` inside formatted.

    turns: conv_id, path, depth_from_root, role, text; null roles and texts are empty. Spans hold escaped text.
    """
    e = template.escape
    turn = F.struct(F.col("depth_from_root").alias("d"), e(F.coalesce("role", F.lit(""))).alias("role"), e(F.coalesce("text", F.lit(""))).alias("text"), F.col("role").eqNullSafe(trained).alias("loss"))
    whole = turns.groupBy("conv_id", "path").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    made = F.transform("turns", lambda t: F.concat(F.lit(template.before), t.role, F.lit(template.between), t.text, F.lit(template.after)))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, t):
        start = acc.at + len(template.before) + F.length(t.role) + len(template.between)
        span = F.array(F.struct((start + 1).cast("int").alias("start"), F.length(t.text).cast("int").alias("length")))
        return F.struct((start + F.length(t.text) + len(template.after)).cast("int").alias("at"), F.when(t.loss, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return whole.select("conv_id", "path", F.array_join(made, "").alias("formatted"), F.aggregate("turns", none, step).spans.alias("loss"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, path, formatted, turns: array of (role, text) as they were, trained_text: the text under the loss mask, unescaped."""
    pieces = F.filter(F.split("formatted", template.after, -1), lambda x: x != "")
    u = template.unescape

    def turn(x: Column) -> Column:
        cut = F.instr(x, template.between)
        role = F.substring(x, F.lit(len(template.before) + 1), cut - 1 - len(template.before))
        text = F.substring(x, cut + len(template.between), F.length(x))
        return F.struct(u(role).alias("role"), u(text).alias("text"))

    # each span is unescaped alone: nothing joins across two texts
    masked = F.transform("loss", lambda s: u(F.substring(F.col("formatted"), s.start, s.length)))
    return formatted.select("conv_id", "path", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("trained_text"))


def digests(conversations: DataFrame) -> DataFrame:
    """Formats each conversation (rows by turn: one branch; repeated or null turns in the order turn, role, text; rows with a null conv_id: one conversation) and digests what is read back."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    messages = conversations.select("conv_id", "role", "text", F.row_number().over(w).alias("node")).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
    messages = written(messages, "messages")
    back = read_back(format_conversations(branches(messages)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained_text").cast("bigint").alias("loss_chars"), F.sha2("trained_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    kind = "conv_id bigint, turn bigint, role string, text string"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], kind)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("bigint"), "role", "text")
    return digests(table.unionByName(more))


def reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best branches of each conversation read as a tree: turn t replies to turn (t - 1) / 2, and a message scores by the length of its text, so that ties come up."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = F.col("turn").cast("bigint")
    tree = c.select("conv_id", t.alias("node"), F.when(t > 0, F.floor((t - 1) / 2)).alias("parent"), "role", "text", (F.length(F.coalesce("text", F.lit(""))) % 4).cast("double").alias("score"))
    return branches(tree, top=2).select("conv_id", "path", "depth_from_root", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


TREE_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn::BIGINT AS node, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, role, coalesce(text, '') AS text, length(coalesce(text, '')) % 4 AS score FROM conversations),
r AS (
  SELECT conv_id, node AS leaf, node, parent, score AS total, 0 AS up FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.parent = c.node)
  UNION ALL SELECT r.conv_id, r.leaf, c.node, c.parent, r.total + c.score, r.up + 1 FROM r JOIN c ON c.conv_id = r.conv_id AND c.node = r.parent
),
e AS (SELECT conv_id, leaf, max(up) AS depth, max(total) AS total FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, leaf) AS path FROM e)
SELECT r.conv_id, path::INTEGER AS path, (depth - up)::INTEGER AS depth_from_root, role, sha256(text) AS text_sha256 FROM r JOIN k USING (conv_id, leaf) JOIN c ON c.conv_id = r.conv_id AND c.node = r.node WHERE path <= 2
"""

ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS erole,
            regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS etext FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(erole) + length(etext) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
