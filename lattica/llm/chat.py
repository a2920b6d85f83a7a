"""Chat formatting: root-to-leaf paths of reply trees, each as one conversation with a loss mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, pick, table

#: The template. Prompt turns: PROMPT role newline text PROMPT_END; answers, under the loss mask: ANSWER text ANSWER_END.
PROMPT, PROMPT_END, ANSWER, ANSWER_END = "[INST] ", " [/INST]", "<s>", "</s>"
ANSWER_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Put one more backslash into each control string, after its bracket: [INST] becomes [\\INST]."""
    text = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST\])", "[$1$2")


def _escape_role(role: Column) -> Column:
    """A role stands on a line of its own, so its newlines and backslashes are written as \\n and \\\\."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def best_paths(nodes: DataFrame, top_k: int = 1) -> DataFrame:
    """(tree, leaf, node, up) of the top_k root-to-leaf paths of each tree; nodes: (tree string, node, parent, score).

    up counts from the leaf. Paths rank by the sum of their scores, then by length, then by the smaller leaf.
    A node whose parent is absent is a root; nodes on or below a cycle have no root and are left out.
    Self-joins double the reach: after round k a node knows its 2^k-th ancestor, so depth d takes log2(d) rounds,
    and only nodes that haven't met their root take part in the next.
    """
    same = lambda a, b: [F.col(a[0]) == F.col(b[0]), F.col(a[1]) == F.col(b[1])]
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    jump = nodes.join(known, same(("tree", "parent"), ("_t", "_n")), "left").select("tree", "node", F.col("_n").alias("anc"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth"))
    level = materialise(jump)
    done, open_, jumps = [level.where("anc IS NULL")], level.where("anc IS NOT NULL"), []
    n, left = level.agg(F.count(F.lit(1)), F.count("anc")).first()
    while left and 2 ** len(jumps) <= n:  # any path is shorter than the table: what stays open then is a cycle
        jumps.append(open_)
        above = reduce(DataFrame.unionByName, done, open_).select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("anc").alias("_a"), F.col("total").alias("_s"), F.col("depth").alias("_d"))
        met = open_.join(above, same(("tree", "anc"), ("_t", "_n")))
        level = materialise(met.select("tree", "node", F.col("_a").alias("anc"), (F.col("total") + F.col("_s")).alias("total"), (F.col("depth") + F.col("_d")).alias("depth")))
        done.append(level.where("anc IS NULL"))
        open_ = level.where("anc IS NOT NULL")
        left = open_.count()
    rooted = reduce(DataFrame.unionByName, done)
    parents = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("_t"), F.col("parent").alias("_n"))
    leaves = rooted.join(parents, same(("tree", "node"), ("_t", "_n")), "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), F.asc("node"))
    path = leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top_k).select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    path = materialise(path)
    for k, jump in enumerate(jumps):
        step = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "anc")
        reached = path.join(step, same(("tree", "node"), ("_t", "_n"))).select("tree", "leaf", F.col("anc").alias("node"), (F.col("up") + 2**k).alias("up"))
        path = materialise(path.unionByName(reached))
    return path


def format_paths(turns: DataFrame) -> DataFrame:
    """(conv, formatted, loss_mask) from (conv, pos, role, text); loss_mask: spans (start from 0, length), in order.

    A conversation is one value in the end, so its turns meet in one task; nothing else does. Null roles and texts are
    empty; turns of equal pos go by what is written of them; a null conv is a conversation of its own; other columns are
    ignored; of an empty table nothing is formatted.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = escape(text)
    answer = role == ANSWER_ROLE
    piece = F.when(answer, F.concat(F.lit(ANSWER), body, F.lit(ANSWER_END))).otherwise(F.concat(F.lit(PROMPT), _escape_role(role), F.lit("\n"), body, F.lit(PROMPT_END)))
    before = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pieces = turns.select("conv", "pos", piece.alias("piece"), F.when(answer, F.length(body)).alias("masked"))
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)))
    span = F.when(F.col("masked").isNotNull(), F.struct((F.col("start") + len(ANSWER)).alias("start"), F.col("masked").cast("long").alias("length")))
    whole = placed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "piece", span.alias("span")))).alias("p"))
    return whole.select("conv", F.array_join("p.piece", "").alias("formatted"), F.filter("p.span", lambda s: s.isNotNull()).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """turns (role, text) and loss_texts, found from the formatted text and its mask alone; columns of formatted stay.

    Rows are on their own, so repeated ones each give a row. A null formatted text or mask gives null turns or texts; an
    empty one has none.
    """
    segments = F.filter(F.split("formatted", r"(?=<s>|\[INST\] )"), lambda s: s != "")
    inner = lambda s: F.substr(s, F.lit(len(PROMPT) + 1), F.length(s) - len(PROMPT + PROMPT_END))
    role = lambda b: F.substring_index(b, "\n", 1)

    def turn(s: Column) -> Column:
        b = inner(s)
        answer = F.struct(F.lit(ANSWER_ROLE).alias("role"), unescape(F.substr(s, F.lit(len(ANSWER) + 1), F.length(s) - len(ANSWER + ANSWER_END))).alias("text"))
        prompt = F.struct(_unescape_role(role(b)).alias("role"), unescape(F.substr(b, F.length(role(b)) + 2)).alias("text"))
        return F.when(s.startswith(ANSWER), answer).otherwise(prompt)

    masked = F.zip_with(F.filter("_segments", lambda s: s.startswith(ANSWER)), "loss_mask", lambda s, m: unescape(F.substr(s, F.lit(len(ANSWER) + 1), m["length"].cast("int"))))
    out = formatted.withColumn("_segments", segments)
    return out.withColumn("turns", F.transform("_segments", turn)).withColumn("loss_texts", masked).drop("_segments")


def format_reply_trees(
    messages: DataFrame, *, tree_col: str = "tree_id", node_col: str = "node_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str = "score", top_k: int = 1
) -> DataFrame:
    """tree, leaf, formatted, loss_mask: the top_k best paths of each reply tree as conversations.

    Null roles and texts are empty, a null score is 0, a null tree is a tree of its own. Rows with a null node
    are left out. Of rows that repeat a node one stays: the first by parent, role and text. Other columns are
    ignored; an empty table gives no rows. Only turns of the role "assistant" are under the loss mask.
    """
    m = pick(messages, tree=tree_col, node=node_col, parent=parent_col, role=role_col, text=text_col, score=score_col).where("node IS NOT NULL")
    m = m.withColumn("key", F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit("null")))
    one = m.groupBy("key", "node").agg(F.min(F.struct("parent", "role", "text", F.col("score").cast("double").alias("score"), "tree")).alias("m")).select("key", "node", "m.*")
    one = materialise(one)
    path = best_paths(one.select(F.col("key").alias("tree"), "node", "parent", "score"), top_k)
    turns = path.join(one.select(F.col("key").alias("_t"), F.col("node").alias("_n"), "role", "text", F.col("tree").alias("name")), (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n")))
    turns = turns.select(F.struct("tree", "leaf", "name").alias("conv"), (-F.col("up")).alias("pos"), "role", "text")
    return format_paths(turns).select(F.col("conv.name").alias("tree"), F.col("conv.leaf").alias("leaf"), "formatted", "loss_mask")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a tree with one branch: each row, by turn, answers the one before it.

    Turns go by number, null first, then by role and text (null first); rows that repeat all of these are turns of their own. Null
    roles and texts are empty, a null conv_id is a conversation of its own, other columns are ignored. An empty table leaves
    conversation -1, which is planted.
    """
    rows = pick(table(spark, sf_dir, "conversations"), conv="conv_id", turn="turn", role="role", text="text")
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv long, turn long, role string, text string")
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    nodes = rows.unionByName(planted).withColumn("node", F.row_number().over(order).cast("long")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))
    formatted = format_reply_trees(nodes, tree_col="conv", node_col="node", parent_col="parent")
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS e FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(e) + CASE WHEN role = 'assistant' THEN 7 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
