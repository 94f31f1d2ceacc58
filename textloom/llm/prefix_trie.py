"""Conversation prefix trie as burst tries.

A turn is 32 characters: hash of role and text, and the text's length. A conversation is cut into segments of 1,024
turns, strings of these; the segments that follow equal ones hang below that one's end, so a segment's trie is like that of a short conversation.
Equal segments below one head are one suffix with its number of conversations and smallest id.

1. All suffixes below a head start in one container. Containers over four MB burst: what all suffixes share
   is split off as a chain, each suffix goes to the container of its next turn. A round bursts all that are too large;
   rounds go on as long as there are any. Depth costs no rounds, only branching above large containers does.
2. What is left are containers that fit a task: sorted, and swept into nodes with a stack of open ones.
3. Burst heads get their nodes from the sums of the containers below them, last round first.

Segments are worked off from the last one to the first, as far down as two conversations agree; below, each turn is
a node of its own and needs no container. Turns are numbered over ranges of (conversation, turn), so no task holds a
whole conversation. The ids that end in a node are hashed from chunks in order, streamed through one task: SHA-256 has to
read them one after another.

Defined cases: rows without conv_id are no conversation's; a null turn comes first; turns of one number are ordered by role, then by the
hash of role and text; equal rows are a turn each; null roles and texts are empty; conversations without turns end
in the root; an empty table has no root; columns beyond those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import table, with_keyed, written

TURN, SEGMENT, LIMIT, SHARED = 32, 1024, 4 << 20, 9
NONE = hashlib.sha256(b"").hexdigest()
#: What a sweep gives: nodes, sums for the container above, and sums of the suffixes below a segment's head.
NODE, SUM, HEAD = 0, 1, 2
OUT = "kind int, up string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_key string"
COLUMNS = [x.split()[0] for x in OUT.split(", ")]


def turn_code(role: Column, text: Column) -> Column:
    """32 characters: md5 of role and text, and the text's length in bytes."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.base64(F.concat(F.unhex(F.md5(whole)), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))))


def text_bytes(code: str) -> int:
    return int.from_bytes(base64.b64decode(code[-12:])[-8:], "big")


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, pos, code): each conversation's turns from 1 on, a stored table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    codes = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), turn_code(role, text).alias("code"))
    codes = written(codes, "turns").withColumn("tie", F.rand(7))
    order = ["conv", F.asc_nulls_first("turn"), "role", "code", "tie"]
    dealt = codes.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.select("conv", "code", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ordered")
    # a conversation has a row for each part that it reaches into
    first = dealt.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("conv", "part", (before + 1 - F.col("first")).alias("shift"))
    return written(dealt.join(first, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "code"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, code, total) of the rebuilt conversations, and (conv, total) of all: those without turns, too."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv").cast("string")) % SHARED).withColumn("base", F.col("conv") - F.col("conv") % 5)
    convs = convs.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    kept = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.withColumn("kept", kept).withColumn("total", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs, "conversations")
    own = with_keyed(turns, convs.select("conv", "n", "h", "kept", "total"), ["conv"]).filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"), "code", "total")
    first = turns.filter((F.col("conv") % 5 == 0) & (F.col("pos") < SHARED)).withColumnRenamed("conv", "base")
    given = convs.filter("kept > 0").select("conv", "base", "kept", "total").join(first, "base").filter("pos <= kept").select("conv", "pos", "code", "total")
    return own.unionByName(given), convs.select("conv", "total")


def segments(turns: DataFrame, size: int) -> DataFrame:
    """(conv, seg, head, suf, key, last): head and key name the path before and up to the segment's end; a stored table."""
    seg = turns.withColumn("seg", F.floor((F.col("pos") - 1) / size))
    rows = seg.groupBy("conv", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("own"), F.any_value("total").alias("total"))
    rows = rows.select("conv", "seg", F.array_join("own.code", "").alias("suf"), (F.col("seg") == F.floor((F.col("total") - 1) / size)).alias("last"), (F.col("total") > size).alias("long"))
    rows = written(rows, "suffixes")
    short = rows.filter("not long").select("conv", "seg", F.lit("").alias("head"), "suf", _key(F.lit(""), F.md5("suf")).alias("key"), "last")
    long = rows.filter("long")
    if long.isEmpty():
        return short
    hashes = long.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", F.md5("suf").alias("h")))).alias("own"))
    path = F.aggregate("own.h", F.array(F.lit("")), lambda keys, h: F.concat(keys, F.array(_key(F.element_at(keys, -1), h))))
    path = hashes.withColumn("path", path).select("conv", F.posexplode("path").alias("seg", "head"), "path")
    path = path.select("conv", F.col("seg").cast("long").alias("seg"), "head", F.get("path", F.col("seg") + 1).alias("key")).filter("key is not null")
    return written(short.unionByName(long.join(path, ["conv", "seg"]).select("conv", "seg", "head", "suf", "key", "last")), "segments")


def _key(head: Column, digest: Column) -> Column:
    return F.md5(F.concat(head, digest))


class Node:
    """An open node of a sweep. below: closed children, which wait for this node's smallest id."""

    __slots__ = ("bytes", "below", "children", "end", "leaves", "low", "n", "saved")

    def __init__(self, size: int):
        self.bytes, self.below, self.children, self.leaves, self.saved, self.n, self.low, self.end = size, [], 0, 0, 0, 0, None, None

    def add(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(low, self.low)

    def ends(self, row: tuple) -> None:
        """A suffix that ends here; what hangs below its segment counts here, too."""
        self.add(row.n, row.low)
        self.end = row.key if row.ended else None
        self.children += row.b_children
        self.leaves += row.b_leaves
        self.saved += row.b_saved

    def close(self, above: Node, depth: int, out: list[tuple]) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.bytes
        out.extend((NODE, None, *x[:2], self.low, *x[2:]) for x in self.below)
        above.below.append((self.low, depth, self.n, self.children, self.leaves, self.saved, self.end))
        above.children += 1
        above.leaves += self.leaves
        above.saved += self.saved
        above.add(self.n, self.low)


def _swept(box: list[tuple]) -> list[tuple]:
    """Rows of OUT of one container: rows in the order of suffixes."""
    out: list[tuple] = []
    first = box[0]
    stack, last = [Node(text_bytes(first.top) if first.top else 0)], ""
    close = lambda: stack.pop().close(stack[-1], first.depth + len(stack), out)
    for row in box:
        shared, most = 0, min(len(row.suf), len(last)) // TURN
        while shared < most and row.suf[shared * TURN : (shared + 1) * TURN] == last[shared * TURN : (shared + 1) * TURN]:
            shared += 1
        while len(stack) > shared + 1:
            close()
        for k in range(shared, len(row.suf) // TURN):
            stack.append(Node(text_bytes(row.suf[k * TURN : (k + 1) * TURN])))
        stack[-1].ends(row)
        last = row.suf
    while len(stack) > 1:
        close()
    top = stack[0]
    if first.top:
        above = Node(0)
        top.close(above, first.depth, out)
        low, depth, *rest = above.below[0]
        out.append((NODE, None, low, depth, first.above, *rest))
        out.append((SUM, first.up, None, None, None, None, 1, top.leaves, top.saved, None))
    else:
        out.extend((NODE, None, *x[:2], first.above, *x[2:]) for x in top.below)
        out.append((HEAD, first.box, None, None, None, None, top.children, top.leaves, top.saved, None))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({c: "Int64" for c in COLUMNS if c not in ("up", "end_key")})


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    box: list[tuple] = []
    out: list[tuple] = []
    for b in batches:
        for row in b.itertuples(index=False, name="Row"):
            if box and row.box != box[0].box:
                out += _swept(box)
                box = []
            box.append(row)
        if len(out) > 10_000:
            yield _frame(out)
            out = []
    yield _frame(out + (_swept(box) if box else []))


def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of OUT of burst containers: the head's node, if it has one, and the turns that all suffixes share."""
    for b in batches:
        out = []
        for r in b.itertuples(index=False, name="Row"):
            codes = ([r.top] if r.top else []) + [r.a[k * TURN : (k + 1) * TURN] for k in range(r.shared)]
            depth = r.depth + (0 if r.top else 1)
            children, leaves, saved = r.s_children + r.e_children, r.s_leaves + r.e_leaves, r.s_saved + r.e_saved
            end = r.e_key
            for k in range(len(codes) - 1, -1, -1):
                saved += (r.members - 1) * text_bytes(codes[k])
                out.append((NODE, None, r.box_low, depth + k, r.box_low if k else r.above, r.members, children, leaves, saved, end))
                children, end = 1, None
            out.append((SUM, r.up, None, None, None, None, 1, leaves, saved, None) if r.top else (HEAD, r.box, None, None, None, None, children, leaves, saved, None))
        yield _frame(out)


BOX = ["box", "up", "top", "depth", "above", "suf", "n", "low", "key", "ended", "b_children", "b_leaves", "b_saved"]


def tries(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of OUT for the suffixes of heads; rows: BOX, where above is the head's own smallest id and top is null. A stored table."""
    front, small, bursts = written(rows.select(BOX), "front"), None, []
    one = [F.any_value(c).alias(c) for c in ("up", "top", "depth", "above")]
    while True:
        sizes = front.groupBy("box").agg(F.count("*").alias("k"), F.sum(F.length("suf") + 64).alias("bytes"), F.min("suf").alias("a"), F.max("suf").alias("z"), F.sum("n").alias("members"), F.min("low").alias("box_low"), *one)
        sizes = sizes.withColumn("big", (F.col("k") > 1) & (F.col("bytes") > limit))
        steps = F.sequence(F.lit(1), (F.least(F.length("a"), F.length("z")) / TURN).cast("int"))
        prefix = F.size(F.filter(steps, lambda i: F.substring(F.col("a"), F.lit(1), i * TURN) == F.substring(F.col("z"), F.lit(1), i * TURN)))
        shared = F.when(F.col("big") & (F.length("a") >= TURN), prefix).otherwise(0)
        sizes = written(sizes.withColumn("shared", shared).withColumn("a", F.when(F.col("big"), F.expr(f"substring(a, 1, shared * {TURN})"))).drop("z", "bytes"), "sizes")
        big = sizes.filter("big")
        if big.isEmpty():
            return _nodes(front if small is None else small.unionByName(front), bursts)
        marked = written(with_keyed(front, sizes.select("box", F.col("k").alias("n"), "big", "shared", "box_low"), ["box"]), "marked")
        stays = marked.filter("not big").select(BOX)
        small = stays if small is None else small.unionByName(stays)
        cut = F.col("shared") * TURN
        moved = marked.filter("big").withColumn("cut", cut)
        ended = moved.filter(F.length("suf") == F.col("cut")).select("box", F.when(F.col("ended"), F.col("key")).alias("e_key"), *[F.col(f"b_{c}").alias(f"e_{c}") for c in ("children", "leaves", "saved")])
        bursts.append((big, ended))
        next_box = F.md5(F.concat("box", F.expr(f"substring(suf, 1, cut + {TURN})")))
        above = F.when(F.col("top").isNull() & (F.col("shared") == 0), F.col("above")).otherwise(F.col("box_low"))
        moved = moved.filter(F.length("suf") > F.col("cut")).select(
            next_box.alias("box"), F.col("box").alias("up"), F.expr(f"substring(suf, cut + 1, {TURN})").alias("top"), (F.col("depth") + F.col("shared") + 1).alias("depth"), above.alias("above"), F.expr(f"substring(suf, cut + {TURN + 1})").alias("suf"), *BOX[6:]
        )
        front = written(moved, "front")


def _nodes(boxes: DataFrame, bursts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    out = written(boxes.repartition("box").sortWithinPartitions("box", "suf").mapInPandas(sweep, OUT), "nodes", batch_rows=5000)
    for big, ended in reversed(bursts):
        sums = out.filter(F.col("kind") == SUM).groupBy(F.col("up").alias("box")).agg(F.sum("n_children").alias("s_children"), F.sum("n_leaves").alias("s_leaves"), F.sum("saved_tokens").alias("s_saved"))
        rows = big.join(sums, "box", "left").join(ended, "box", "left").fillna(0, [f"{x}_{c}" for x in "se" for c in ("children", "leaves", "saved")])
        out = out.unionByName(written(rows.mapInPandas(chains, OUT), "chains"))
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """(end_key, ends_sha256) of (key, conv): the ids in numeric order, hashed as decimals with commas."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b.groupby("key", sort=False)["conv"]
            yield pd.DataFrame({"key": [k for k, _ in own], "first": [x.iloc[0] for _, x in own], "ids": [",".join(map(str, x.tolist())) for _, x in own]})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, h = None, None
        for b in batches:
            done = []
            for key, ids in zip(b["key"], b["ids"]):
                if key == last:
                    h.update(b",")
                else:
                    if h:
                        done.append((last, h.hexdigest()))
                    last, h = key, hashlib.sha256()
                h.update(ids.encode())
            yield pd.DataFrame(done, columns=["end_key", "ends_sha256"])
        if h:
            yield pd.DataFrame([(last, h.hexdigest())], columns=["end_key", "ends_sha256"])

    dealt = ends.repartitionByRange("conv").sortWithinPartitions("key", "conv").mapInPandas(chunks, "key string, first long, ids string")
    dealt = written(dealt, "chunks", batch_rows=20_000)
    return dealt.repartition("key").sortWithinPartitions("key", "first").mapInPandas(hashed, "end_key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, limit: int = LIMIT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(numbered(conversations))
    units = segments(turns, segment)
    of = ["seg", "head"]
    rows = written(units.groupBy(*of, "suf").agg(F.count("*").alias("n"), F.min("conv").alias("low"), F.max("last").alias("ended"), F.any_value("key").alias("key")), "distinct")
    members = rows.groupBy(*of).agg(F.sum("n").alias("members"))
    alone = members.filter("seg > 0 and members = 1").select("head")
    deepest = members.filter("seg > 0 and members > 1").agg(F.max("seg")).first()[0] or 0
    start = convs.agg(F.min("conv"), F.count("*")).first()
    single = [F.lit(x).cast("long").alias(f"b_{c}") for c, x in (("children", 1), ("leaves", 1), ("saved", 0))]
    nodes, heads, none = None, None, F.lit(None).cast("string")
    for seg in range(deepest, -1, -1):
        own = rows.filter(F.col("seg") == seg)
        below = alone.select(F.col("head").alias("key"), *single)
        own = own.join(below if heads is None else below.unionByName(heads), "key", "left").fillna(0, ["b_children", "b_leaves", "b_saved"])
        if seg:
            above = rows.filter(F.col("seg") == seg - 1).select(F.col("key").alias("head"), F.col("low").alias("above"))
            own = own.join(alone, "head", "left_anti").join(above, "head")
        else:
            own = own.withColumn("above", F.lit(start[0]).cast("long"))
        found = tries(own.select(F.col("head").alias("box"), none.alias("up"), none.alias("top"), F.lit(seg * segment).cast("long").alias("depth"), *BOX[4:]), limit)
        heads = found.filter(F.col("kind") == HEAD).select(F.col("up").alias("key"), F.col("n_children").alias("b_children"), F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved"))
        nodes = found if nodes is None else nodes.unionByName(found)
    root = heads.first()
    cells = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_key"]
    nodes = nodes.filter(F.col("kind") == NODE).select(cells)
    spark = conversations.sparkSession
    if start[1]:
        nodes = nodes.unionByName(spark.createDataFrame([(start[0], 0, None, start[1], root.b_children if root else 0, (root and root.b_leaves) or 1, root.b_saved if root else 0, "")], nodes.schema))
    lone = units.join(alone, "head", "left_semi")
    turn = F.posexplode(F.sequence(F.lit(1), (F.length("suf") / TURN).cast("int")))
    lone = lone.select("*", turn.alias("at", "k")).withColumn("final", F.col("last") & (F.col("k") * TURN == F.length("suf")))
    long = lambda x: F.lit(x).cast("long")
    lone = lone.select(F.col("conv").alias("conv_id"), (F.col("seg") * segment + F.col("k")).alias("depth"), F.col("conv").alias("parent_conv_id"), long(1).alias("n_convs"), F.when(F.col("final"), 0).otherwise(1).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), F.when(F.col("final"), F.col("key")).alias("end_key"))
    nodes = nodes.unionByName(lone)
    ends = units.filter("last").select("key", "conv").unionByName(convs.filter("total = 0").select(F.lit("").alias("key"), "conv"))
    digests = end_digests(ends)
    ended = nodes.filter("end_key is not null").join(digests, "end_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
    return ended.drop("end_key").unionByName(nodes.filter("end_key is null").drop("end_key").withColumn("ends_sha256", F.lit(NONE)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b:
    list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)), 4294967295::BIGINT)) % {SHARED} AS h FROM t
), r AS (
  SELECT c.conv_id, 0 AS k, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), s AS (
  SELECT c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY r.k, r.pos) FILTER (r.pos IS NOT NULL), []) AS seq FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), m AS (
  SELECT conv_id, d, md5(to_json(seq[1:d])) AS path, CASE WHEN d > 0 THEN md5(to_json(seq[1:d - 1])) END AS up, d = len(seq) AS fin, CASE WHEN d > 0 THEN strlen(seq[d].text) ELSE 0 END AS bytes FROM s, unnest(range(len(seq) + 1)) AS u(d)
), n AS (
  SELECT d AS depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (fin), '') AS ends FROM m GROUP BY d, path
), f AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.up = n.path AND x.depth = n.depth + 1) AS n_children FROM n),
below AS (SELECT DISTINCT a.path AS top, a.d AS top_depth, b.path, b.d FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.bytes)::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f LEFT JOIN n p ON p.path = f.up AND p.depth = f.depth - 1 JOIN below b ON b.top = f.path AND b.top_depth = f.depth JOIN f x ON x.path = b.path AND x.depth = b.d
GROUP BY f.conv_id, f.depth, p.conv_id, f.n_convs, f.n_children, f.ends
"""
