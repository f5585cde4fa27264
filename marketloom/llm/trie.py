"""A trie of conversations by their turns.

Every conversation is rebuilt: it begins with the first h turns of the first conversation of its block of BLOCK ids, and goes on with its
own turns after its first h (h: the CRC-32 of its id in decimal, modulo SHARED). A node of depth d stands for the first d turns (role
and text) of the conversations that begin with them.

1. Turns are numbered over the whole table by ranges of the order, so a long conversation is no one task's. A turn is held as a
   digest and a word count; texts don't move.
2. Conversations that are equal throughout are found by an order-free digest of (place, turn) and become one with a weight.
3. Conversations are dealt by the digest of their first turn. A task takes several such groups and builds their subtries in
   applyInPandas: a dictionary from (pointer, turn) to pointer, then a postorder with a stack of its own for what subtrees hold.
4. A group of more than MOST_ROWS turns is first followed to the turn where it splits, which gives the chain of nodes above, and
   dealt again by its next turn; and so on. A conversation that is alone in such a group is written as a chain without a task of its own.
   The totals of the chains come from those of the groups below, from the deepest round up.

Rows with a null conv_id take no part. A null role or text is empty, a null turn comes first; rows of one turn are put in the order of role
and text, and rows that repeat are turns of their own. A conversation without turns is a member of the root only. An empty table has
no node. Texts of any length count whole. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.shipping import ship
from marketloom.llm.common import on_batches, word_count, written
from marketloom.operators.numbering import numbered

BLOCK, SHARED = 20, 4
#: Turns of a group that one task takes whole, and turns that tasks get on average.
MOST_ROWS, A_TASK = 1 << 15, 1 << 14
#: Bytes of ids that are joined before they are hashed.
CHUNK = 1 << 16
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, at long, least long"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), key (digest of role and text), words of every turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    slim = rows.select("conv", "turn", "key", word_count(F.col("text")).alias("words"))
    tied = written(slim.groupBy("conv", "turn").count().where("count > 1").select("conv", "turn"), "tied")
    slim = slim.withColumn("tie", F.lit(0).cast("long"))
    if not tied.isEmpty():
        same = lambda a, b: (a["conv"] == b["conv"]) & a["turn"].eqNullSafe(b["turn"])
        order = numbered(rows.join(tied, same(rows, tied), "left_semi"), [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "tie")
        ranks = written(order.groupBy("conv", "turn", "key").agg(F.min("tie").alias("tie")), "ties")
        slim = slim.drop("tie").join(ranks, same(slim, ranks) & (slim["key"] == ranks["key"]), "left").select(slim["conv"], slim["turn"], slim["key"], "words", F.coalesce("tie", F.lit(0)).alias("tie"))
    n = numbered(slim, [F.col("conv"), F.asc_nulls_first("turn"), F.col("tie"), F.col("key")]).select("conv", "n", "key", "words")
    first = written(n.groupBy("conv").agg(F.min("n").alias("first")), "first")
    return n.join(first, "conv").select("conv", (F.col("n") - F.col("first") + 1).alias("pos"), "key", "words")


def rebuilt(rows: DataFrame, block: int = BLOCK, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(turns of rebuilt conversations, all conversations). Only the first turns of a block's first conversation are joined."""
    c = F.col("conv")
    convs = rows.groupBy("conv").agg(F.count("*").alias("total")).select("conv", "total", (F.crc32(c.cast("string").cast("binary")) % shared).alias("h"), (c - c % block).alias("base"))
    convs = written(convs, "conversations")
    told = convs.join(convs.select(c.alias("base"), F.col("total").alias("there")), "base", "left").select("conv", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("lead"))
    told = written(told, "leads")
    lead = told.where("lead > 0").join(rows.where(F.col("pos") < shared).withColumnRenamed("conv", "base"), "base").where("pos <= h").select("conv", "pos", "key", "words")
    own = rows.join(told, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "key", "words")
    return written(lead.unionByName(own), "rebuilt"), convs.select("conv")


def _same(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, length, class (the least conversation that is equal throughout), weight."""
    mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "pos", "key"))
    signs = rows.groupBy("conv").agg(F.count("*").alias("length"), mark(1).alias("a"), mark(2).alias("b"))
    signs = written(convs.join(signs, "conv", "left").select("conv", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("length", "a", "b"))), "signs")
    classes = written(signs.groupBy("length", "a", "b").agg(F.min("conv").alias("class"), F.count("*").alias("weight")), "classes")
    return written(signs.join(classes, ["length", "a", "b"]).select("conv", "length", "class", "weight"), "members")


def ends_digests(members: DataFrame) -> DataFrame:
    """class, ends_sha256: of the ids of each class in their order. Ids of a class are joined where they lie in the order; the task that
    hashes a class holds one chunk of them at a time."""
    single = members.where("weight = 1").select("class", F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held, size = None, None, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"class": pa.array([at], pa.int64()), "first": pa.array([first], pa.int64()), "ids": [",".join(held)]})

        for batch in batches:
            for c, i in zip(batch.column("class").to_pylist(), batch.column("conv").to_pylist()):
                if held and (c != at or size > CHUNK):
                    yield chunk()
                    held, size = [], 0
                if not held:
                    at, first = c, i
                held.append(str(i))
                size += len(held[-1]) + 1
        if held:
            yield chunk()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for c, ids in zip(batch.column("class").to_pylist(), batch.column("ids").to_pylist()):
                if state is not None and c == at:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    yield pa.RecordBatch.from_pydict({"class": pa.array([at], pa.int64()), "ends_sha256": [state.hexdigest()]})
                at, state = c, hashlib.sha256(ids.encode())
        if state is not None:
            yield pa.RecordBatch.from_pydict({"class": pa.array([at], pa.int64()), "ends_sha256": [state.hexdigest()]})

    several = members.where("weight > 1").select("class", "conv").repartitionByRange("class", "conv").sortWithinPartitions("class", "conv")
    chunks = on_batches(several, joined, "class long, first long, ids string")
    return single.unionByName(on_batches(chunks.repartition("class").sortWithinPartitions("class", "first"), hashed, "class long, ends_sha256 string"))


def subtries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of several groups. rows: conv, weight, pos, key, words, at and least (depth and conversation of the node above the group)."""
    rows = rows.sort_values(["least", "at", "conv", "pos"], kind="stable")
    to: dict[tuple, int] = {}
    node: list[list] = []  # conv, depth, parent pointer, weight, words, ends
    below: list[list[int]] = []
    tops: dict[tuple[int, int], int] = {}
    before, pointer = None, -1
    for conv, weight, pos, key, words, at, least in rows[["conv", "weight", "pos", "key", "words", "at", "least"]].itertuples(index=False, name=None):
        if (conv, at, least) != before:
            if before is not None:
                node[pointer][5] = before[0]
            before = (conv, at, least)
            pointer = tops.setdefault((at, least), len(node))
            if pointer == len(node):
                node.append([least, at, -1, 0, 0, None])
                below.append([])
        child = to.setdefault((pointer, key), len(node))
        if child == len(node):
            node.append([conv, pos, pointer, 0, words, None])
            below.append([])
            below[pointer].append(child)
        node[child][0] = min(node[child][0], conv)
        node[child][3] += weight
        pointer = child
    if before is not None:
        node[pointer][5] = before[0]
    leaves, saved, out = [0] * len(node), [0] * len(node), []
    for (at, least), top in tops.items():
        stack = [(top, False)]
        while stack:
            p, done = stack.pop()
            if not done:
                stack.append((p, True))
                stack.extend((c, False) for c in below[p])
                continue
            conv, depth, parent, weight, words, ends = node[p]
            leaves[p] = sum(leaves[c] for c in below[p]) or 1
            saved[p] = max(weight - 1, 0) * words + sum(saved[c] for c in below[p])
            if p != top:
                out.append((conv, depth, node[parent][0], weight, len(below[p]), leaves[p], saved[p], ends, at, least))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])
    return frame.astype({c: "Int64" for c in frame.columns})


def _groups(rows: DataFrame, active: DataFrame) -> DataFrame:
    """active with the digest of the turn after the node each conversation has come to. active: conv, weight, length, at, least."""
    return written(rows.join(active, "conv").where(F.col("pos") == F.col("at") + 1).select("conv", "weight", "length", "at", "least", "key"), "dealt")


def nodes(rows: DataFrame, reps: DataFrame, root: int, most_rows: int = MOST_ROWS, a_task: int = A_TASK) -> DataFrame:
    """All nodes but the root, with ends (the class that ends there). rows: turns of reps; reps: conv, weight, length, each conversation
    once that differs from all others."""
    ship(rows.sparkSession)
    active = reps.where("length > 0").select("conv", "weight", "length", F.lit(0).cast("long").alias("at"), F.lit(root).cast("long").alias("least"))
    done: list[DataFrame] = []
    large: list[DataFrame] = []
    group = ["at", "least", "key"]
    while True:
        dealt = _groups(rows, active)
        sizes = dealt.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("length") - F.col("at")).alias("turns"), F.min("conv").alias("spine"), F.sum("weight").alias("total"))
        sizes = written(sizes.withColumn("kind", F.when(F.col("turns") <= most_rows, "small").when(F.col("n") == 1, "lone").otherwise("large")), "sizes")
        told = dealt.join(sizes, group)
        turns_small = sizes.where("kind = 'small'").agg(F.sum("turns")).first()[0] or 0
        tasks = max(1, -(-turns_small // a_task))
        small = told.where("kind = 'small'").select("conv", "weight", "at", "least", F.pmod(F.xxhash64(*group), F.lit(tasks)).alias("task"))
        done.append(written(rows.join(small, "conv").where("pos > at").groupBy("task").applyInPandas(subtries, _NODE), "nodes"))
        if sizes.where("kind <> 'small'").isEmpty():
            break
        done.append(written(_lone(rows, told.where("kind = 'lone'")), "nodes"))
        big = sizes.where("kind = 'large'")
        if big.isEmpty():
            break
        # each large group goes down to the last turn that all of it shares
        inside = told.where("kind = 'large'").select("conv", "weight", "length", *group, "spine", "total")
        own = rows.withColumnRenamed("key", "turn").join(inside, "conv").where("pos > at").select(*group, "conv", "pos", "turn", "spine")
        spine = written(own.where("conv = spine").select(*group, "pos", F.col("turn").alias("its")), "spines")
        off = own.join(spine, [*group, "pos"], "left").where("its IS NULL OR its <> turn").groupBy(*group).agg(F.min("pos").alias("off"))
        split = inside.groupBy(*group).agg(F.min("length").alias("shortest")).join(off, group, "left").select(*group, F.least("shortest", F.coalesce(F.col("off") - 1, F.col("shortest"))).alias("to"))
        split = written(big.select(*group, "spine", "total").join(split, group), "splits")
        large.append(split)
        moved = written(inside.drop("spine", "total").join(split, group), "moved")
        done_here = moved.where("length = to").select(F.col("to").alias("depth"), F.col("spine").alias("s"), F.col("conv").alias("ends"))
        large[-1] = written(split.join(done_here, (split["to"] == done_here["depth"]) & (split["spine"] == done_here["s"]), "left").select(*group, "spine", "total", "to", "ends"), "splits")
        active = moved.where("length > to").select("conv", "weight", "length", F.col("to").alias("at"), F.col("spine").alias("least"))
    for split in reversed(large):
        every = _united(done)
        under = every.where("depth = at + 1").groupBy("at", "least").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        top = split.join(under.select(F.col("at").alias("to"), F.col("least").alias("spine"), "n_children", "n_leaves", "saved"), ["to", "spine"], "left")
        top = top.select(*split.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
        chain = rows.select(F.col("conv").alias("spine"), "pos", "words").join(top, "spine").where("pos > at AND pos <= to")
        here = F.sum((F.col("total") - 1) * F.col("words")).over(Window.partitionBy("at", "least", "spine").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
        last = F.col("pos") == F.col("to")
        done.append(
            written(
                chain.select(
                    F.col("spine").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("at") + 1, F.col("least")).otherwise(F.col("spine")).alias("parent_conv_id"), F.col("total").alias("n_convs"),
                    F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("saved") + here).alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends"), "at", "least",
                ),
                "nodes",
            )
        )
    return _united(done)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lone(rows: DataFrame, lone: DataFrame) -> DataFrame:
    """The chains of conversations that share no further turn with others."""
    tail = rows.select("conv", "pos", "words").join(lone.select("conv", "weight", "length", "at", "least"), "conv").where("pos > at")
    rest = F.sum((F.col("weight") - 1) * F.col("words")).over(Window.partitionBy("conv").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))

    def chain(df: DataFrame, saved: Column) -> DataFrame:
        return df.select(
            F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("at") + 1, F.col("least")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
            (F.col("pos") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"), F.when(F.col("pos") == F.col("length"), F.col("conv")).alias("ends"), "at", "least",
        )

    return chain(tail.where("weight = 1"), F.lit(0).cast("long")).unionByName(chain(tail.where("weight > 1"), rest))


def prefix_trie(conversations: DataFrame, most_rows: int = MOST_ROWS, a_task: int = A_TASK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows, convs = rebuilt(turns(conversations))
    members = _same(rows, convs)
    reps = written(members.where("conv = class").select("conv", "weight", "length"), "classes")
    total = reps.agg(F.min("conv"), F.sum("weight")).first()
    root = total[0] if total[0] is not None else 0
    own = written(rows.join(reps.select("conv"), "conv"), "turns")
    found = nodes(own, reps, root, most_rows, a_task)
    top = found.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    none = reps.where("length = 0").agg(F.min("conv").alias("ends"))
    lead = reps.agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs")).where("conv_id IS NOT NULL")
    # three single rows side by side
    root_row = lead.crossJoin(top).crossJoin(none).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = found.select(*columns, "ends").unionByName(root_row)
    ended = every.where("ends IS NOT NULL").join(ends_digests(members).withColumnRenamed("class", "ends"), "ends").select(*columns, "ends_sha256")
    return ended.unionByName(every.where("ends IS NULL").select(*columns, F.lit(NO_ENDS).alias("ends_sha256")))


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))))"

ORACLE = f"""
WITH t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn_, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS total, {_CRC} % 4 AS h, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
m AS (SELECT c.*, least(c.h, coalesce(b.total, 0)) AS lead FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT m.conv_id, t.pos, t.turn_ FROM m JOIN t ON t.conv_id = m.base AND t.pos <= m.h UNION ALL SELECT m.conv_id, t.pos - m.h + m.lead, t.turn_ FROM m JOIN t ON t.conv_id = m.conv_id AND t.pos > m.h),
s AS (SELECT m.conv_id, coalesce(list(turn_ ORDER BY pos) FILTER (pos IS NOT NULL), []) AS seq FROM m LEFT JOIN r ON r.conv_id = m.conv_id GROUP BY m.conv_id),
p AS MATERIALIZED (SELECT conv_id, d, seq[1:d] AS path, len(seq) = d AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(seq[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM s, range(len(seq) + 1) g(d)),
n AS MATERIALIZED (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM p GROUP BY d, path),
e AS MATERIALIZED (SELECT n.d, n.conv_id, q.conv_id AS parent_conv_id, n.n_convs, n.words, n.ended FROM n LEFT JOIN n q ON q.d = n.d - 1 AND q.path = n.path[1:n.d - 1]),
k AS (SELECT d - 1 AS d, parent_conv_id AS conv_id, count(*) AS n_children FROM e WHERE d > 0 GROUP BY ALL),
f AS MATERIALIZED (SELECT e.*, coalesce(k.n_children, 0) AS n_children FROM e LEFT JOIN k ON k.d = e.d AND k.conv_id = e.conv_id),
a AS (SELECT n.d, n.conv_id, sum((f.n_convs - 1) * f.words) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d JOIN n ON n.d = p.d AND n.path = p.path GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ended) AS ends_sha256 FROM f JOIN a ON a.d = f.d AND a.conv_id = f.conv_id
"""
