"""Conversation prefix trie (operator 13): a burst trie over turns. Heads are nodes with too many conversations to
sweep in one task; their containers, burst by the next turn ids, hold what is left and are sorted and swept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.numbering import numbered

from ._work import lean, read_table, stored, text_or_empty

#: Conversations and turns of a container that is swept, and levels that a round bursts at most.
MOST, MOST_TURNS, LEVELS = 200, 1 << 16, 256
#: Hexadecimal digits of a turn's id.
ID = 32
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = b""
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(conversations: DataFrame, shared: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """((c, len), (c, pos, tid, words)): every conversation, and its turns after it took its first turns from
    another: the first h of c - c % ``shared``, h being the crc32 of c modulo ``most``."""
    role, text = text_or_empty(F.col("role")), text_or_empty(F.col("text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), text.alias("text"))
    tid = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, ID)
    rows = rows.withColumn("tid", tid).withColumn("words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    turn = F.col("turn").asc_nulls_first()
    own = stored(numbered(rows, ["c"], [turn, F.col("role"), F.col("text")], ["tid", "words"], "p", [turn, F.col("role"), F.substring("text", 1, 64)]), "own")

    first = own.filter(F.col("p") < most - 1).select(F.col("c").alias("b"), "p", "tid", "words")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    convs = own.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % shared).alias("b"))
    k = F.least("h", F.coalesce("held", F.lit(0)))
    convs = convs.join(first.groupBy("b").agg(F.count(F.lit(1)).alias("held")), "b", "left").withColumn("k", k)
    convs = stored(convs.select("c", "b", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")), "convs")
    taken = convs.filter("k > 0").join(first, "b").filter("p < h").select("c", F.col("p").alias("pos"), "tid", "words")
    rest = own.join(convs.select("c", "h", "k"), "c").filter("p >= h").select("c", (F.col("p") - F.col("h") + F.col("k")).alias("pos"), "tid", "words")
    return convs.select("c", "len"), stored(taken.unionByName(rest), "turns")


def _suffixes(turns: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """One row a conversation of ``of``: its turns in order."""
    met = turns.join(of, "c")
    return met.filter(F.col("pos") >= F.col("depth") - 1).groupBy("c", *keys).agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("w"))


def _burst(turns: DataFrame, going: DataFrame, depth: int, levels: int, most: int, most_turns: int) -> tuple[DataFrame, DataFrame]:
    """((key, parent, start, path, depth, words, n, low, big), (c, len, state)): the nodes of the next ``levels``
    turns under the active heads, and for each of their conversations the first node that isn't oversized, or
    else the last one. A node's key is the digest of its head's key and the next turn id."""
    met = turns.filter((F.col("pos") >= depth) & (F.col("pos") < depth + levels)).join(going, "c")
    lists = met.groupBy("c", "len", "key").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("w"))
    chained = F.aggregate("w", F.array("key"), lambda a, x: F.concat(a, F.array(F.unhex(F.md5(F.concat(F.element_at(a, -1), x["tid"].cast("binary")))))))
    rows = lists.withColumn("keys", chained).select("c", "len", "keys", F.posexplode("w").alias("i", "x"))
    key, parent = F.get("keys", F.col("i") + 1), F.get("keys", F.col("i"))
    rows = stored(rows.select("c", "len", key.alias("key"), parent.alias("parent"), F.slice("keys", F.lit(1), F.col("i") + 1).alias("path"), (F.col("x.pos") + 1).alias("depth"), F.col("x.words").alias("words")), "levels")
    same = [F.any_value(x).alias(x) for x in ("parent", "path", "depth", "words")]
    nodes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.sum(F.col("len") - F.col("depth") + 1).alias("turns"), *same)
    nodes = stored(nodes.withColumn("big", (F.col("n") > most) | ((F.col("n") > 1) & (F.col("turns") > most_turns))).drop("turns"), "nodes")
    placed = rows.select("c", "len", "key", "parent", "depth").join(nodes.select("key", "big", "n"), "key")
    at = F.struct("big", F.when(F.col("big"), -F.col("depth")).otherwise(F.col("depth")).alias("order"), "key", "parent", "depth", "n")
    return nodes, stored(placed.groupBy("c", "len").agg(F.min(at).alias("at")).select("c", "len", "at.*").drop("order"), "placed")


def _ids(value: bytes | str) -> list[str]:
    return [value[i : i + ID] for i in range(0, len(value), ID)]


KINDS = [pa.binary(), *[pa.int64()] * 7, pa.string()]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers, their suffixes in sorted order: a stack holds the open nodes of the last suffix. A node is told
    when its parent closes, for only then its parent's smallest member is known."""
    names, out = ["head", *NODE], []
    stack: list[dict] = []
    at, last, head = None, [], None

    def close(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            node["saved"] += (node["n"] - 1) * node["words"]
            leaves = node["leaves"] or 1
            out.extend((None, *row[:2], node["low"], *row[2:]) for row in node["told"])
            row = (node["low"], node["depth"], node["n"], node["children"], leaves, node["saved"], node["ends"].hexdigest() if node["ends"] else EMPTY)
            if stack:
                up = stack[-1]
                up["n"], up["low"], up["children"] = up["n"] + node["n"], min(up["low"], node["low"]), up["children"] + 1
                up["leaves"], up["saved"] = up["leaves"] + leaves, up["saved"] + node["saved"]
                up["told"].append(row)
            else:
                out.append((head, *row[:2], None, *row[2:]))

    def told() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), KINDS)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for key, parent, depth, c, seq, words in zip(*(batch.column(x).to_pylist() for x in ("key", "parent", "depth", "c", "seq", "words"))):
            if key != at:
                close(0)
                at, last, head = key, [], parent
            ids, k = _ids(seq), 0
            while k < len(last) and k < len(ids) and last[k] == ids[k]:
                k += 1
            close(k)
            for i in range(k, len(ids)):
                stack.append({"low": c, "depth": depth + i, "n": 0, "children": 0, "leaves": 0, "saved": 0, "words": words[i], "ends": None, "told": []})
            node, last = stack[-1], ids
            node["n"], node["low"] = node["n"] + 1, min(node["low"], c)
            if node["ends"]:
                node["ends"].update(f",{c}".encode())
            else:
                node["ends"] = hashlib.sha256(str(c).encode())
        if len(out) > 10_000:
            yield told()
    close(0)
    if out:
        yield told()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each head's ends, which come sorted; no list of them is held."""
    at, sha = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])
    for batch in batches:
        for key, c in zip(*(x.to_pylist() for x in batch.columns)):
            if key == at:
                sha.update(f",{c}".encode())
                continue
            if sha:
                yield row()
            at, sha = key, hashlib.sha256(str(c).encode())
    if sha:
        yield row()


def _subtrees(rounds: list[DataFrame], below: DataFrame) -> DataFrame:
    """(key, n_leaves, saved): sums of the heads' subtrees, last round first. ``below`` (key, leaves, saved) is what
    containers and single conversations add to their head."""
    up, out = below.limit(0), None
    for heads in reversed(rounds):
        own = heads.select("key", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), "own_saved")
        added = below.unionByName(up).groupBy("key").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        each = own.join(added, "key", "left").select("key", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("own_saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        way = F.explode(F.transform(F.concat("path", F.array("key")), lambda x, i: F.struct(x.alias("key"), (i == 0).alias("start"))))
        paths = heads.select("key", way.alias("a")) if "path" in heads.columns else heads.select("key", F.struct("key", F.lit(False).alias("start")).alias("a"))
        sums = each.join(paths, "key").groupBy("a.key", "a.start").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        sums = stored(sums, "subtrees")
        up = sums.filter("start").select("key", "leaves", "saved")
        mine = sums.filter("NOT start").select("key", F.col("leaves").alias("n_leaves"), "saved")
        out = mine if out is None else out.unionByName(mine)
    return out


def trie(conversations: DataFrame, most: int = MOST, most_turns: int = MOST_TURNS) -> DataFrame:
    """One row a node of the prefix trie of the rebuilt conversations: the columns of ``NODE``.

    Conversations are ordered by turn, null first; turns of one number by role, then text, and repeated rows stay.
    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. A null
    text and an empty one make the same turn. Conversations whose rows are all replaced are turnless and end at
    the root. An empty table has no members, so no node, not even a root. Other columns are not carried.

    Turns become ids of 128 bits; texts move once, to be ordered. The root is a head. In a round, the active heads'
    conversations burst by their next turn ids, 1, 1, 2, 4, ... levels at once, and each stays at its first node
    of at most ``most`` conversations and ``most_turns`` turns (a conversation that is alone has no limit): that
    node is a container. A container goes to one task as sorted suffixes; what is alone needs no task."""
    convs, turns = rebuilt(conversations)
    total = convs.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"))
    root = total.filter("n > 0").select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n", "low")
    root = stored(root, "root")
    active, depth, levels = stored(convs.withColumn("key", F.lit(ROOT)), "active"), 0, 1
    found, settled, ended, nodes = [root], [], [active.filter("len = 0").select("key", "c")], []
    active = active.filter("len > 0")
    while not active.isEmpty():
        made, placed = _burst(turns, active, depth, levels, most, most_turns)
        nodes.append(made.select("key", "parent"))
        found.append(made.filter("big").select("key", "parent", "depth", "words", "n", "low", "path"))
        settled.append(placed.filter("NOT big").select("c", "key", "parent", "depth", "n"))
        ended.append(placed.filter("big AND len = depth").select("key", "c"))
        active = placed.filter("big AND len > depth").select("c", "len", "key")
        depth, levels = depth + levels, min(LEVELS, max(1, depth + levels))
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])

    if not settled:
        settled.append(ended[0].select("c", "key", F.col("key").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n")).limit(0))
        nodes.append(settled[0].select("key", "parent"))
    placed = union(settled)
    alone, packed = placed.filter("n = 1").drop("n"), placed.filter("n > 1").drop("n")
    seqs = _suffixes(turns, packed, "key", "parent", "depth").select("key", "parent", "depth", "c", F.array_join(F.transform("w", lambda x: x["tid"]), "").alias("seq"), F.transform("w", lambda x: x["words"]).alias("words"))
    swept = seqs.repartition("key").sortWithinPartitions("key", "seq", "c").mapInArrow(lean(_swept), "head binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    swept = stored(swept, "swept")

    tops = swept.filter("head IS NOT NULL").select(F.col("head").alias("key"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    ones = alone.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("leaves"), F.lit(0).cast("long").alias("saved"))
    below = stored(tops.unionByName(ones), "below")
    children = union(nodes).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rounds = []
    for heads in found:
        counted = heads.join(children, "key", "left").withColumn("n_children", zero("n_children"))
        rounds.append(stored(counted.withColumn("own_saved", (F.col("n") - 1) * F.col("words")), "heads"))
    heads = union([h.select("key", "parent", "depth", "n", "low", "n_children") for h in rounds])
    sums = _subtrees(rounds, below)
    ends = union(ended).repartition("key").sortWithinPartitions("key", "c").mapInArrow(lean(_ends), "key binary, ends_sha256 string")
    lows = heads.select(F.col("key").alias("parent"), F.col("low").alias("over"))
    sha = F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    top = heads.join(lows, "parent", "left").join(sums, "key").join(ends, "key", "left")
    top = top.select(F.col("low").alias("conv_id"), "depth", F.col("over").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), sha)

    inner = swept.join(lows, swept["head"] == lows["parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over")).select(*NODE)
    tails = turns.join(alone.join(lows, "parent").join(convs, "c").select("c", "depth", "len", "over"), "c").filter(F.col("pos") >= F.col("depth") - 1)
    one, final = F.lit(1).cast("long"), F.col("pos") + 1 == F.col("len")
    over: Column = F.when(F.col("pos") == F.col("depth") - 1, F.col("over")).otherwise(F.col("c"))
    digest = F.when(final, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))
    tails = tails.select(F.col("c").alias("conv_id"), (F.col("pos") + 1).alias("depth"), over.alias("parent_conv_id"), one.alias("n_convs"), F.when(final, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), digest.alias("ends_sha256"))
    return top.unionByName(inner).unionByName(tails)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read_table(spark, sf_dir, "conversations"))


#: The crc32 of a text's bytes, bit by bit: each byte is mixed in, then seven times nothing.
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split({0}, ''), lambda s: [ord(s)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, v: xor(xor(a, v) >> 1, 3988292384::UBIGINT * (xor(a, v) & 1))))"
OP13_SQL = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS b, cast({_CRC.format("cast(c AS VARCHAR)")} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM own)),
kept AS (SELECT c, b, h, least(h, (SELECT count(*) FROM own o WHERE o.c = b)) AS k FROM convs),
turns AS (SELECT k.c, p AS pos, role, text FROM kept k JOIN own ON own.c = k.b AND p < h UNION ALL SELECT k.c, p - h + k, role, text FROM kept k JOIN own ON own.c = k.c AND p >= h),
seqs AS (SELECT c, coalesce(list(sha256(concat(length(role), ':', role, text)) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids, coalesce(list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS words FROM kept LEFT JOIN turns USING (c) GROUP BY c),
way AS (SELECT c, d, sha256(array_to_string(ids[:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(ids[:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w, d = len(ids) AS last FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM seqs)),
nodes AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own, coalesce(string_agg(cast(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends FROM way GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n FROM nodes GROUP BY up),
subs AS (SELECT w.node, sum(n.own) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM nodes n JOIN way a ON a.node = n.node AND a.c = n.conv_id JOIN way w ON w.c = a.c AND w.d <= a.d LEFT JOIN kids k ON k.node = n.node GROUP BY w.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, cast(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.node = n.up LEFT JOIN kids k ON k.node = n.node JOIN subs s ON s.node = n.node
"""
