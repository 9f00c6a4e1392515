"""The trie of conversation prefixes, built in shards between splitter paths.

A turn becomes a fingerprint of role and text (MD5, 32 hex digits) and its number of code points; texts are not moved. A
conversation is its path, the fingerprints of its turns in order. All conversations are ordered by (path, id). A bounded sample
gives splitters, each a path and an id, so a path that very many conversations share is cut as well. Between two
splitters lies a shard. It is sorted and read once with a stack: a node closes when a path leaves it, and its sums pass to
its parent.

A node whose conversations lie in several shards is a prefix of the splitter between them. Those prefixes form a trie, the
skeleton, which is broadcast: at most `MOST_SHARDS` paths. All other nodes are finished in their shard. For a skeleton
node a shard sends its partial sums, which are added up in Spark; then sums run up the skeleton from its
leaves. The ids that end at a skeleton node come from each shard in order, in pieces, and are hashed piece by
piece without being gathered.

Rebuilding: conversation c gets the first h original turns of conversation c - c % group, then its own after its first
h; h is the unsigned CRC-32 of c's decimal digits modulo `heads`.

Defined cases: turns are ordered by turn, null first, equal ones by fingerprint; repeated rows are turns of their own; null
role or text is empty; rows with a null conv_id take no part; a conversation without turns after rebuilding is a member of the root
and ends there; % takes the sign of the id; an empty table has no root. One conversation is one row of 36 bytes a
turn. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.session import staged

WIDE = 32  # characters of a fingerprint
MOST_SHARDS = 1024
SHARD_ROWS = 20_000
SAMPLED = 16  # sampled conversations per shard
PIECE = 4096  # ids that travel as one text
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_SCHEMA = pa.schema(
    [("skeleton", pa.int32()), ("shard", pa.int32()), ("piece", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_skeleton", pa.int32())]
    + [(c, pa.int64()) for c in _SUMS]
    + [("ends", pa.string()), ("turn", pa.string())]
)
_SPARK = "skeleton int, shard int, piece int, conv_id long, depth long, parent_conv_id long, parent_skeleton int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, turn string"


def fingerprint(role: Column, text: Column) -> Column:
    """MD5 of a turn: the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def paths(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, path, chars): the conversations as they stand."""
    role, text = F.col(f"`{role_col}`"), F.col(f"`{text_col}`")
    rows = turns.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.struct(F.col(f"`{turn_col}`").alias("t"), fingerprint(role, text).alias("fp"), F.coalesce(F.char_length(text), F.lit(0)).alias("chars")).alias("turn")
    )
    # nulls come first in arrays of structs
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("conv", F.array_join("turns.fp", "").alias("path"), F.col("turns.chars").alias("chars"))


def rebuilt(convs: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """`paths` with the first turns of each conversation taken from the first one of its group."""
    base = F.col("conv") - F.col("conv") % group
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    most = heads - 1
    firsts = convs.filter(base == F.col("conv")).select(F.col("conv").alias("_base"), F.substring("path", 1, WIDE * most).alias("_path"), F.slice("chars", 1, most).alias("_chars"))
    both = convs.withColumns({"_at": base, "_h": h}).join(firsts, F.col("_at") == F.col("_base"), "left")
    path = F.concat(F.coalesce(F.substring("_path", F.lit(1), F.col("_h") * WIDE), F.lit("")), F.substring("path", F.col("_h") * WIDE + 1, F.length("path")))
    nothing = F.array().cast("array<int>")
    chars = F.concat(F.coalesce(F.slice("_chars", F.lit(1), F.col("_h")), nothing), F.slice("chars", F.col("_h") + 1, F.size("chars")))
    return both.select("conv", path.alias("path"), chars.alias("chars"))


def splitters(convs: DataFrame, shards: int) -> list[tuple[str, int]]:
    """At most shards - 1 conversations that cut the ordered table into about equal shards."""
    total = convs.count()
    most = SAMPLED * shards
    few = F.pmod(F.xxhash64("conv"), F.lit(1 << 30)) < min(1 << 30, (most << 30) // max(1, total))
    sample = staged(convs.filter(few).select("path", "conv"))
    held = sample.count()
    numbered = sample.withColumn("k", F.row_number().over(Window.orderBy("path", "conv")))  # the sample only
    step = max(1, -(-held // shards))
    return [(r["path"], r["conv"]) for r in numbered.filter((F.col("k") % step == 0)).orderBy("k").select("path", "conv").collect()][: shards - 1]


class Skeleton:
    """The trie of splitter paths: node 0 is the root, a node's parent has a smaller number."""

    def __init__(self, cuts: list[tuple[str, int]]):
        self.cuts, self.parents, self.depths = cuts, [-1], [0]
        self.chains: list[list[int]] = []  # of each splitter, its nodes from the root down
        at: dict[tuple[int, str], int] = {}
        for path, _ in cuts:
            chain = [0]
            for i in range(0, len(path), WIDE):
                key = (chain[-1], path[i : i + WIDE])
                if key not in at:
                    at[key] = len(self.parents)
                    self.parents.append(chain[-1])
                    self.depths.append(len(chain))
                chain.append(at[key])
            self.chains.append(chain)

    def shard(self, path: str, conv: int) -> int:
        return bisect_right(self.cuts, (path, conv))

    def bounds(self, shard: int) -> list[tuple[str, list[int]]]:
        """Paths and nodes of the splitters before and after a shard."""
        return [(self.cuts[i][0], self.chains[i]) for i in (shard - 1, shard) if 0 <= i < len(self.cuts)]


def common(a: str, b: str, start: int = 0) -> int:
    """Number of leading turns that two paths share, at least `start`."""
    most = min(len(a), len(b)) // WIDE
    while start < most and a[start * WIDE : start * WIDE + WIDE] == b[start * WIDE : start * WIDE + WIDE]:
        start += 1
    return start


class _Node:
    """An open node of a shard. Members come sorted by path, so those that end here come first, by id."""

    def __init__(self, skeleton: int | None, turn: str | None, chars: int):
        self.skeleton, self.turn, self.chars = skeleton, turn, chars
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.least: int | None = None
        self.hash, self.ended, self.pieces = hashlib.sha256() if skeleton is None else None, 0, 0
        self.ends: list[int] = []
        self.below: list[tuple] = []  # finished children, which wait for this node's smallest member


class Shard:
    """Reads the sorted conversations of one shard; `out` gets rows of _SCHEMA."""

    def __init__(self, number: int, skeleton: Skeleton, out: list[tuple]):
        self.number, self.bounds, self.out = number, skeleton.bounds(number), out
        self.open: list[_Node] = [_Node(0, None, 0)]
        self.before = ""

    def add(self, conv: int, path: str, chars: list[int]) -> None:
        same = common(path, self.before)
        while len(self.open) - 1 > same:
            self._close()
        for depth in range(same + 1, len(path) // WIDE + 1):
            self.open.append(_Node(self._skeleton(path, depth), path[depth * WIDE - WIDE : depth * WIDE], chars[depth - 1]))
        self.before = path
        for node in self.open:
            node.n_convs += 1
            node.least = conv if node.least is None else min(conv, node.least)
        self._end(self.open[-1], conv)

    def _skeleton(self, path: str, depth: int) -> int | None:
        parent = self.open[-1].skeleton
        if parent is not None:
            for cut, chain in self.bounds:
                if len(chain) > depth and chain[depth - 1] == parent and path[depth * WIDE - WIDE : depth * WIDE] == cut[depth * WIDE - WIDE : depth * WIDE]:
                    return chain[depth]
        return None

    def _end(self, node: _Node, conv: int) -> None:
        if node.hash is not None:
            node.hash.update((("," if node.ended else "") + str(conv)).encode())
        else:
            node.ends.append(conv)
            if len(node.ends) == PIECE:
                self._piece(node)
        node.ended += 1

    def _piece(self, node: _Node) -> None:
        self.out.append((node.skeleton, self.number, node.pieces, None, None, None, None, None, None, None, None, ",".join(map(str, node.ends)), node.turn))
        node.ends, node.pieces = [], node.pieces + 1

    def _close(self) -> None:
        node, above = self.open.pop(), self.open[-1] if self.open else None
        depth = len(self.open)
        for conv, deep, sums, sha, turn in node.below:
            parent = (None, node.skeleton) if node.skeleton is not None else (node.least, None)
            self.out.append((None, None, None, conv, deep, *parent, *sums, sha, turn))
        if node.skeleton is not None:
            if node.ends:
                self._piece(node)
            # saved and leaves are those of finished nodes below; what the node adds itself waits for all shards
            self.out.append((node.skeleton, self.number, -1, node.least, depth, None, None, node.n_convs, node.n_children, node.n_leaves, node.saved, str(node.chars), node.turn))
            return
        leaves, saved = node.n_leaves or 1, node.saved + (node.n_convs - 1) * node.chars
        above.n_children += 1
        above.n_leaves += leaves
        above.saved += saved
        above.below.append((node.least, depth, (node.n_convs, node.n_children, leaves, saved), node.hash.hexdigest(), node.turn))

    def close(self) -> None:
        while self.open:
            self._close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _scanned(convs: DataFrame, skeleton: Skeleton, shards: int) -> DataFrame:
    """Finished nodes, and partial sums and pieces of skeleton nodes, of all shards."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [skeleton.shard(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv").to_pylist(), strict=True)]
            yield batch.append_column("shard", pa.array(found, pa.int32()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, path, chars, shard in zip(*(batch.column(c).to_pylist() for c in ("conv", "path", "chars", "shard")), strict=True):
                if now is None or now.number != shard:
                    if now is not None:
                        now.close()
                    now = Shard(shard, skeleton, out)
                now.add(conv, path, chars)
                if len(out) >= 2000:
                    yield _batch(out)
                    out.clear()
        if now is not None:
            now.close()
        for i in range(0, len(out), 2000):
            yield _batch(out[i : i + 2000])

    dealt = convs.select("conv", "path", "chars").mapInArrow(number, "conv long, path string, chars array<int>, shard int")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv").mapInArrow(scan, _SPARK)


def _hashed(pieces: DataFrame) -> DataFrame:
    """(skeleton, ends): SHA-256 of the pieces of each skeleton node in order, read one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for node, text in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if now is not None:
            out.append((now, digest.hexdigest()))
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], names=["skeleton", "ends"])

    parts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = pieces.repartition(parts, "skeleton").sortWithinPartitions("skeleton", "shard", "piece").select("skeleton", "ends")
    return ordered.mapInArrow(run, "skeleton int, ends string")


def _reduced(partial: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """Finished skeleton nodes: (skeleton, conv_id, depth, parent_conv_id, sums, turn); at most as many as the splitters' turns."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    rows = partial.groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *sums, F.max(F.col("ends").cast("long")).alias("chars"), F.max("turn").alias("turn")).collect()
    nodes = {r["skeleton"]: r.asDict() for r in rows}
    for k in sorted(nodes, reverse=True):  # children have larger numbers than their parents
        node = nodes[k]
        node["saved_tokens"] += (node["n_convs"] - 1) * node["chars"] if k else 0
        node["n_leaves"] = node["n_leaves"] or 1
        if k:
            above = nodes[skeleton.parents[k]]
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
    return [(k, n["conv_id"], skeleton.depths[k], nodes[skeleton.parents[k]]["conv_id"] if k else None, *[n[c] for c in _SUMS], n["turn"]) for k, n in nodes.items()]


def trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """A row per node of the trie of `paths`; `turn` is the fingerprint of its last turn."""
    spark = convs.sparkSession
    convs = staged(convs)
    if shards is None:
        shards = min(MOST_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), convs.count() // SHARD_ROWS))
    skeleton = Skeleton(splitters(convs, shards))
    found = staged(_scanned(convs, skeleton, max(1, len(skeleton.cuts) + 1)))
    inner = _reduced(found.filter("piece = -1"), skeleton)
    bones = spark.createDataFrame(inner, "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, turn string")
    # both tables below hold at most one row per turn of a splitter
    ends = F.broadcast(_hashed(found.filter("piece >= 0")).withColumnRenamed("skeleton", "_k"))
    nothing = hashlib.sha256(b"").hexdigest()
    named = bones.join(ends, F.col("skeleton") == F.col("_k"), "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(nothing)))
    columns = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256", "turn"]
    above = F.broadcast(bones.select(F.col("skeleton").alias("_k"), F.col("conv_id").alias("_above")))
    local = found.filter("skeleton is null").join(above, F.col("parent_skeleton") == F.col("_k"), "left")
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).withColumnRenamed("ends", "ends_sha256")
    return local.select(*columns).unionAll(named.select(*columns))


def with_texts(nodes: DataFrame, turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes with role and text of their last turn; the root's are null."""
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    known = turns.groupBy(fingerprint(role, text).alias("turn")).agg(F.first(role).alias("role"), F.first(text).alias("text"))
    return nodes.join(known, "turn", "left")


def query(turns: DataFrame) -> DataFrame:
    return trie(rebuilt(paths(turns))).drop("turn")


SQL = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, fp) AS k, fp, n FROM (
    SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS fp, length(coalesce(text, '')) AS n
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT c, xor(list_reduce([4294967295] || list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT), lambda a, b:
      list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)
), heads AS (SELECT v.c, t.k, t.fp, t.n FROM convs v JOIN turns t ON t.c = v.c - v.c % 100 AND t.k <= v.h)
, kept AS (
  SELECT c, k, fp, n FROM heads
  UNION ALL SELECT t.c, 1000000 + t.k, t.fp, t.n FROM turns t JOIN convs v ON v.c = t.c AND t.k > v.h
), member AS (
  SELECT c, '' AS prefix, 0 AS depth, 0 AS n FROM convs
  UNION ALL SELECT c, string_agg(fp, '') OVER w, row_number() OVER w, n FROM kept WINDOW w AS (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING)
), ending AS (SELECT c, prefix FROM (SELECT c, prefix, depth, max(depth) OVER (PARTITION BY c) AS most FROM member) WHERE depth = most)
, ended AS (SELECT prefix, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM ending GROUP BY prefix)
, node AS (SELECT prefix, depth, any_value(n) AS n, min(c) AS conv_id, count(*) AS n_convs FROM member GROUP BY prefix, depth)
, above AS (SELECT left(prefix, (depth - 1) * 32) AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1)
, summed AS (
  SELECT left(x.prefix, d * 32) AS prefix, sum((a.prefix IS NULL)::INT) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved
  FROM node x LEFT JOIN above a ON a.prefix = x.prefix, unnest(range(0, x.depth + 1)) u(d) GROUP BY 1)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(a.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM node x JOIN summed s ON s.prefix = x.prefix LEFT JOIN above a ON a.prefix = x.prefix LEFT JOIN ended e ON e.prefix = x.prefix
LEFT JOIN node p ON p.depth = x.depth - 1 AND x.depth > 0 AND p.prefix = left(x.prefix, (x.depth - 1) * 32)
"""
