"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins double the reach of each message's pointer:
after k rounds it knows its 2^k-th ancestor, its depth and the score of its path, so a tree of
any depth takes log2(depth) rounds. Leaves are ranked by the score of their root-to-leaf path
and the best of each tree are chosen; the saved pointers then enumerate the messages of each
chosen path in as many rounds. A path becomes one conversation.

Template: every turn is START role BETWEEN text END. Control strings inside roles and texts,
those of this template and of other common ones, are broken by a backslash after their first
character, and backslashes are doubled, so reading back gives every text unchanged and no
control string survives in one.

Defined results: null roles and texts count as empty; a message whose parent is missing is a
root; messages on or below a cycle belong to no path; messages that repeat a tree and message
id are one node of the tree for each of their places in row order (`numbered` gives ids where
rows only have an order); a null tree id is a tree; ties of paths go to the smaller leaf; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlark.llm.common import table
from orderlark.session import stored

START, BETWEEN, END = "<|start|>", "<|says|>", "<|end|>"
# Control strings of common templates.
CONTROL = (START, BETWEEN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
BACKSLASH = "\\"


def _quoted(x: str) -> str:
    return "".join(f"\\{c}" if c in "|[]/<>\\" else c for c in x)


#: A control string's first character where the rest follows.
BREAK = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROL)


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit(BACKSLASH), F.lit(BACKSLASH * 2))
    return F.regexp_replace(doubled, f"({BREAK})", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\(\\\\?)", "$1")


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def pointers(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From (tree, message, parent, score): each message's root, depth and path score, and the
    tables of 1st, 2nd, 4th, ... ancestors (tree, message, up).

    A path without a cycle has at most as many messages as its tree, so a tree takes part
    in log2(its size) rounds, and only messages that have not met their root are joined.
    """
    known = messages.select(F.col("tree").alias("_t"), F.col("message").alias("_m"))
    linked = messages.join(known, same("tree", "_t") & (F.col("parent") == F.col("_m")), "left")
    sizes = messages.groupBy(F.col("tree").alias("_t")).agg(F.count(F.lit(1)).alias("size"))
    first = linked.drop("_t").join(sizes, same("tree", "_t"))
    state = stored(first.select("tree", "message", F.col("_m").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").cast("double").alias("path"), "size"), "pointers")
    reached, jumps = [], []
    while True:
        length = 1 << len(jumps)
        live = state.where(F.col("size") > length)
        below = live.where("up IS NOT NULL")
        if below.isEmpty():
            # No message looks further up; pointers left in finished trees belong to cycles.
            reached.append(state.where("up IS NULL"))
            break
        reached.append(state.where((F.col("size") <= length) & F.col("up").isNull()))
        jumps.append(below.select("tree", "message", "up"))
        above = live.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        met = below.join(above, same("tree", "_t") & (F.col("up") == F.col("_m")))
        met = met.select("tree", "message", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("path") + F.coalesce("_path", F.lit(0.0))).alias("path"), "size")
        state = stored(live.where("up IS NULL").unionByName(met), "pointers")
    return reduce(DataFrame.unionByName, reached).drop("up", "size"), jumps


def best_leaves(messages: DataFrame, reached: DataFrame, top: int) -> DataFrame:
    """(tree, leaf, depth, path, rank) of the `top` best paths of each tree."""
    parents = messages.where("parent IS NOT NULL").select(F.col("tree").alias("_t"), F.col("parent").alias("_p")).distinct()
    leaves = reached.join(parents, same("tree", "_t") & (F.col("message") == F.col("_p")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("path"), "message")
    ranked = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.withColumnRenamed("message", "leaf")


#: Jumps in one plan; then the members found so far are written.
HOPS = 4


def path_messages(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, message, at) of all messages of the chosen paths, at counting from the leaf.

    A path enters at the longest jump that fits into it.
    """
    start = leaves.select("tree", "leaf", F.col("leaf").alias("message"), F.lit(0).cast("long").alias("at"), "depth")
    members = None
    for k, jump in reversed(list(enumerate(jumps))):
        entering = start.where((F.col("depth") > (1 << k)) & (F.col("depth") <= (2 << k))).drop("depth")
        members = entering if members is None else members.unionByName(entering)
        hop = jump.withColumnsRenamed({"tree": "_t", "message": "_m"})
        met = members.join(hop, same("tree", "_t") & (F.col("message") == F.col("_m")), "left")
        # Each member stays and brings the ancestor the jump leads to; one plan, no copies of it.
        both = F.array(F.struct("message", "at"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("message"), (F.col("at") + (1 << k)).alias("at"))))
        members = met.select("tree", "leaf", F.explode(both).alias("m")).where("m IS NOT NULL").select("tree", "leaf", "m.message", "m.at")
        if k and k % HOPS == 0:
            members = stored(members, "members")
    alone = start.where("depth = 1").drop("depth")
    return alone if members is None else members.unionByName(alone)


def conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """One formatted conversation per chosen path: tree, leaf, rank, score, n_turns,
    formatted, and loss, the (start, end) code points of the assistant texts in it.

    messages: tree, message, parent, role, text, score.
    """
    reached, jumps = pointers(messages.select("tree", "message", "parent", "score"))
    leaves = stored(best_leaves(messages, reached, top), "leaves")
    members = path_messages(leaves, jumps)
    said = messages.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), F.coalesce("role", F.lit("")).alias("role"), "text")
    said = said.withColumns({"head": F.concat(F.lit(START), escaped(F.col("role")), F.lit(BETWEEN)), "body": escaped(F.col("text"))})
    turns = members.join(said, same("tree", "_t") & (F.col("message") == F.col("_m")))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("at"), "role", "head", "body")))
    out = turns.groupBy("tree", "leaf").agg(ordered.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    # Running offsets in one pass over the turns.
    step = (
        "aggregate(turns, struct(0 AS at, CAST(array() AS array<struct<start: int, end: int>>) AS spans), "
        "(a, t) -> struct(a.at + char_length(t.head) + char_length(t.body) + {end} AS at, "
        "IF(t.role = 'assistant', concat(a.spans, array(struct(a.at + char_length(t.head) AS start, a.at + char_length(t.head) + char_length(t.body) AS end))), a.spans) AS spans), a -> a.spans)"
    ).format(end=len(END))
    out = out.select("tree", "leaf", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), F.expr(step).alias("loss"))
    ranks = leaves.select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"), "rank", F.col("path").alias("score"))
    return out.join(ranks, same("tree", "_t") & (F.col("leaf") == F.col("_l"))).drop("_t", "_l")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pattern = f"(?s){_quoted(START)}(.*?){_quoted(BETWEEN)}(.*?){_quoted(END)}"
    whole = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))
    part = lambda x, i: unescaped(F.regexp_extract(x, pattern, i))
    return F.transform(whole, lambda x: F.struct(part(x, 1).alias("role"), part(x, 2).alias("text")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def numbered(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row replies to the one
    before it by turn; ties by role and text. Longer texts score higher."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = rows.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    return at.select(
        F.col("conv_id").alias("tree"),
        "message",
        F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"),
        "role",
        "text",
        F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("score"),
    )


#: A conversation of control strings, which every run formats besides the table's.
PROBE_ID = -7
PROBE = "</s>[INST] ok [/INST]"


def op8_reply_trees(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    made = stored(conversations(stored(numbered(rows.unionByName(probe)), "messages")), "conversations")
    digest = F.concat_ws("", F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = made.withColumns({"turns": read_back(F.col("formatted")), "loss_text": under_loss(F.col("formatted"), F.col("loss"))})
    return loss.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op8_reply_trees": op8_reply_trees}

_BROKEN = r"replace(coalesce({0}, ''), '\', '\\')"
for _c in CONTROL:
    _BROKEN = f"replace({_BROKEN}, '{_c}', '{_c[0]}\\{_c[1:]}')"
ORACLE = {
    "op8_reply_trees": rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE}'), ({PROBE_ID}, 1, 'assistant', '{PROBE}')),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_BROKEN.format('role')}) + length({_BROKEN.format('text')}) + {len(START) + len(BETWEEN) + len(END)})::BIGINT AS formatted_chars
FROM n GROUP BY conv_id""",
}
