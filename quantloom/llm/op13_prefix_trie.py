"""Op 13, the prefix trie of conversations, from sorted matrices of padded turn ids.

Every conversation is a path of turn digests.  Paths are range-partitioned and sorted, equal ones by conv_id, so that no path, however many conversations share it, is in
one task's hands alone.  A task takes its paths in chunks: turns become numbers, the padded matrix is sorted, and where a column changes, or one before it did,
a node starts; sums and minima over these runs give every depth, from the deepest up.  Of a chunk's nodes, only those on its first and its last path can go on in a neighbour: these two paths
are handed on with what their nodes have so far, and the same step runs on the handed-on paths, until they fit one chunk.  All other nodes are done.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import dropped, with_groups, written

#: Turns a conversation may take from the first of its hundred; conversations of a hundred.
HEAD, FAMILY = 6, 100
#: Cells of a chunk's matrix, and paths it has at least (a longer path than cells / paths needs more).
CELLS, LEAST_PATHS = 1_000_000, 16
#: Bytes of a turn's digest: the first half of a SHA-256.
DIGEST = 16
NO_ENDS = sha256(b"").hexdigest()
_NONE = np.iinfo(np.int64).max

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, node binary, parent binary"
_PATH = "path binary, lens array<int>, n array<bigint>, least array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>"
_OUT = f"kind string, part int, chunk int, place int, {_PATH}, {_NODE}, ends string"


def conversation_paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (16 bytes of each turn's SHA-256, one after another), lens (code points of each turn): turns ordered by turn (null first), then by digest.

    turns: conv_id, turn, role, text; null role or text is empty; rows without a conv_id are in no conversation. One conversation is one row (about 40 bytes a turn).
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256), 1, 2 * DIGEST)
    one = F.struct(F.col("turn"), digest.alias("digest"), F.length(text).alias("len"))
    own = turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return own.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.len").alias("lens"))


def shared_heads(paths: DataFrame, head: int = HEAD, family: int = FAMILY) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % family (all if fewer, none if absent), then goes on with its own after its first h; h = crc32(c) % head."""
    heads = paths.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.substring("path", 1, DIGEST * (head - 1)).alias("head"), F.slice("lens", 1, head - 1).alias("head_lens"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    both = paths.withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(heads, "first", "left").withColumn("h", h)
    path = F.concat(F.expr(f"coalesce(substring(head, 1, h * {DIGEST}), X'')"), F.expr(f"substring(path, h * {DIGEST} + 1)"))
    lens = F.concat(F.expr("coalesce(slice(head_lens, 1, h), array())"), F.expr("slice(lens, h + 1, greatest(size(lens) - h, 0))"))
    return both.select("conv_id", path.alias("path"), lens.cast("array<int>").alias("lens"))


def _ragged(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64)


class _Chunk:
    """The trie of some sorted paths."""

    def __init__(self, batch: pa.RecordBatch):
        raw = batch.column("path").to_pylist()
        length = np.array([len(p) // DIGEST for p in raw], np.int64)
        self.deep = int(length.max())
        rows, self.shape = np.repeat(np.arange(len(raw)), length), (len(raw), self.deep)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)
        # numbers in the order of the digests, so that rows of numbers sort as paths do
        _, number = np.unique(np.frombuffer(b"".join(raw), f"S{DIGEST}"), return_inverse=True)
        ids, size = np.full(self.shape, -1, np.int64), np.zeros(self.shape, np.int64)
        ids[rows, at], size[rows, at] = number, _ragged(batch.column("lens"))
        conv = np.asarray(batch.column("conv_id").fill_null(0), np.int64) if "conv_id" in batch.schema.names else None
        # padding sorts first; equal paths by conv_id, or as they were handed on
        order = np.lexsort((np.arange(len(raw)) if conv is None else conv, *ids.T[::-1]))
        ids, self.size, self.length = ids[order], size[order], length[order]
        self.paths, self.conv = [raw[i] for i in order.tolist()], None if conv is None else conv[order]
        change = np.ones(self.shape, bool)
        change[1:] = ids[1:] != ids[:-1]
        self.alive = ids >= 0
        self.starts = np.logical_or.accumulate(change, axis=1) & self.alive
        if self.conv is not None:
            whole = np.zeros((len(raw), self.deep + 1), np.int64)
            self.n, self.least, self.kids, self.leaves, self.saved = whole + 1, whole + self.conv[:, None], whole, whole, whole
        else:
            rows = np.repeat(np.arange(len(raw)), length + 1)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)
            for name in ("n", "least", "kids", "leaves", "saved"):
                table = np.full((len(raw), self.deep + 1), _NONE if name == "least" else 0, np.int64)
                table[rows, at] = _ragged(batch.column(name))
                setattr(self, name, table[order])

    def nodes(self, last: bool):
        """From the deepest level up: depth and, for each node, its first row, parent and sums; `open` marks those on the first and the last path, unless this is the last chunk."""
        below = None
        for depth in range(self.deep, -1, -1):
            alive = np.flatnonzero(self.alive[:, depth - 1]) if depth else np.arange(self.shape[0])
            first = np.flatnonzero(self.starts[alive, depth - 1]) if depth else np.zeros(1, np.int64)
            total = lambda t, f=np.add: f.reduceat(t[alive, depth], first)
            node = {"row": alive[first], "n": total(self.n), "least": total(self.least, np.minimum), "kids": total(self.kids), "leaves": total(self.leaves), "saved": total(self.saved)}
            node["open"] = np.zeros(len(first), bool)
            if not last:
                for edge in (0, self.shape[0] - 1):
                    if self.length[edge] >= depth:
                        node["open"][np.searchsorted(alive[first], edge, "right") - 1] = True
            if below is not None:
                parent = np.searchsorted(node["row"], below["row"], "right") - 1
                below["parent"] = parent
                done = ~below["open"]
                add = lambda x: _added(parent[done], x[done], len(first))
                node["kids"] = node["kids"] + add(np.ones(len(parent), np.int64))
                node["leaves"] = node["leaves"] + add(below["leaves"])
                node["saved"] = node["saved"] + add(below["saved"])
                yield depth + 1, below, node
            closed = ~node["open"]
            size = self.size[node["row"], depth - 1] if depth else np.zeros(1, np.int64)
            node["leaves"] = node["leaves"] + (closed & (node["kids"] == 0))
            node["saved"] = node["saved"] + np.where(closed, (node["n"] - 1) * size, 0)
            below = node
        below["parent"] = np.zeros(1, np.int64)
        yield 0, below, None


def _added(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, where, values)
    return out


def _key(path: bytes, depth: int) -> bytes:
    return sha256(path[: depth * DIGEST]).digest()[:DIGEST] + depth.to_bytes(4, "big")


def _rows(kind: str, **columns) -> pa.RecordBatch:
    """Rows of _OUT; columns not given are null."""
    n = len(next(iter(columns.values())))
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in _OUT.split(",")]
    values = {"kind": [kind] * n} | columns
    return pa.RecordBatch.from_arrays([pa.array(values.get(name, [None] * n), types[t]) for name, t in fields], names=[name for name, _ in fields])


def _chunk_rows(batch: pa.RecordBatch, part: int, chunk: int, last: bool):
    """What a chunk gives: `node` rows (done but for parents that are open), `open` rows (the key of each node handed on), `path` rows (the first and the last path), `ends` rows (members that end at an open node)."""
    trie = _Chunk(batch)
    ended: dict[tuple[int, int], str] = {}  # (first row, depth): the conversations that end at a node
    if trie.conv is not None:
        same = np.ones(len(trie.paths), bool)
        same[1:] = [a != b for a, b in zip(trie.paths[1:], trie.paths[:-1])]
        cuts = np.append(np.flatnonzero(same), len(trie.paths))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            ended[a, int(trie.length[a])] = ",".join(map(str, trie.conv[a:b].tolist()))
    opened, edges = {}, {}
    for depth, node, above in trie.nodes(last):
        out = {c: [] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent", "node")}
        parents = node["parent"].tolist()
        rows, is_open = node["row"].tolist(), node["open"].tolist()
        values = [node[c].tolist() for c in ("least", "n", "kids", "leaves", "saved")]
        for i, (row, is_o) in enumerate(zip(rows, is_open)):
            path = trie.paths[row]
            # shorter paths sort first: what ends at a node are its first rows
            ends = ended.get((row, depth))
            if is_o:
                opened[depth, i] = _key(path, depth)
                edges.setdefault(depth, {})[i] = [v[i] for v in values]
                if ends is not None:
                    yield _rows("ends", part=[part], chunk=[chunk], node=[opened[depth, i]], ends=[ends])
                continue
            over = above is not None and above["open"][parents[i]]
            least, n, kids, leaves, saved = (v[i] for v in values)
            parent_conv = None if depth == 0 or over else int(above["least"][parents[i]])
            # a node handed on by earlier chunks has its ends in the rows of those
            sha = sha256((ends or "").encode()).hexdigest() if trie.conv is not None else None
            for c, v in zip(out, (least, depth, parent_conv, n, kids, leaves, saved, sha, _key(path, depth - 1) if over else None, None if trie.conv is not None else _key(path, depth))):
                out[c].append(v)
        if out["depth"]:
            yield _rows("node", **out)
    if not edges:
        return
    seen = set()
    for place, row in enumerate((0, trie.shape[0] - 1)[: 1 if trie.paths[0] == trie.paths[-1] else 2]):
        size, path = int(trie.length[row]), trie.paths[row]
        sums = {c: [] for c in ("n", "least", "kids", "leaves", "saved")}
        for depth in range(size + 1):
            # at each depth there are two open nodes at most, in the order of the paths
            on = sorted(edges[depth])
            own = on[0] if place == 0 else on[-1]
            given = (depth, own) not in seen
            seen.add((depth, own))
            for c, v in zip(("least", "n", "kids", "leaves", "saved"), edges[depth][own] if given else (_NONE, 0, 0, 0, 0)):
                sums[c].append(v)
        yield _rows("path", part=[part], chunk=[chunk], place=[place], path=[path], lens=[trie.size[row, :size].tolist()], **{c: [v] for c, v in sums.items()})


def _chunks(batches, cells: int):
    """Record batches of sorted paths, each with at most `cells` cells of a padded matrix, or LEAST_PATHS paths."""
    held: list[pa.RecordBatch] = []
    rows, deep = 0, 0
    for batch in batches:
        length = np.array([len(p) // DIGEST for p in batch.column("path").to_pylist()], np.int64)
        at = 0
        while at < batch.num_rows:
            deeper = np.maximum(np.maximum.accumulate(length[at:]), deep)
            many = rows + 1 + np.arange(len(deeper))
            fits = int(((many * (deeper + 1) <= cells) | (many <= LEAST_PATHS)).sum())
            if fits:
                held.append(batch.slice(at, fits))
                rows, deep, at = rows + fits, int(deeper[fits - 1]), at + fits
            if at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, deep = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _step(paths: DataFrame, order: list[str], cells: int, last: bool = False) -> DataFrame:
    """One level: the rows of all chunks of sorted paths, written."""

    def run(batches):
        for chunk, batch in enumerate(_chunks(batches, cells)):
            yield from _chunk_rows(batch, batch.column("at")[0].as_py(), chunk, last)

    ranged = paths.repartition(1) if last else paths.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).withColumn("at", F.spark_partition_id())
    return written(ranged.mapInArrow(run, _OUT), "trie")


def _ends(found: DataFrame) -> DataFrame:
    """node, sha: digests of the members that end at nodes handed on, in order. A node's lists go by in one task, one at a time: a SHA-256 is read from its start to its end."""

    def run(batches):
        node, digest = None, None
        for batch in batches:
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if key != node:
                    if node is not None:
                        yield _digest(node, digest)
                    node, digest = key, sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if node is not None:
            yield _digest(node, digest)

    return found.select("node", "part", "chunk", "ends").repartition("node").sortWithinPartitions("node", "part", "chunk").mapInArrow(run, "node binary, sha string")


def _digest(node: bytes, digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "sha"])


def prefix_trie(paths: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row for each distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    paths: conv_id, path, lens, as conversation_paths() gives them; a path may be empty (its conversation ends at the root). No paths, no nodes. Rows that repeat a
    conv_id count each. A chunk has at most `cells` cells of a padded matrix, or 16 paths.
    """
    found = _step(paths, ["path", "conv_id"], cells)
    steps, first = [found], found.where("kind = 'ends'")
    while True:
        handed = found.where("kind = 'path'")
        size = handed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("lens")).alias("deep")).first()
        if not size["n"]:
            break
        last = size["n"] <= LEAST_PATHS or size["n"] * (size["deep"] + 1) <= cells
        found = _step(handed.select("part", "chunk", "place", *[c.split(" ")[0] for c in _PATH.split(", ")]), ["part", "chunk", "place"], cells, last)
        steps.append(found)
        if last:
            break
    columns = [c.split(" ")[0] for c in _NODE.split(", ")]
    nodes = steps[0].where("kind = 'node'").select(*columns)
    for s in steps[1:]:
        nodes = nodes.unionByName(s.where("kind = 'node'").select(*columns))
    handed_on = nodes.where("node IS NOT NULL").join(_ends(first), "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).drop("sha")
    handed_on = written(handed_on, "trie-handed-on")
    all_nodes = nodes.where("node IS NULL").unionByName(handed_on)
    # parents that were handed on: their smallest member is known now; one with many children is broadcast
    of = handed_on.select(F.col("node").alias("parent"), F.col("conv_id").alias("of"), F.col("n_children").alias("kids"))
    known = all_nodes.where("parent IS NULL")
    rest = with_groups(all_nodes.where("parent IS NOT NULL"), of, ["parent"], "kids").withColumn("parent_conv_id", F.col("of")).drop("of", "kids")
    out = written(known.unionByName(rest).drop("node", "parent"), "trie-nodes")
    dropped(*steps, handed_on)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(shared_heads(written(conversation_paths(turns), "conversation-paths")))


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii((conv_id::VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0] for i in range(1, len(conv_id::VARCHAR) + 1)])),
    lambda s, x: xor(xor(s, x) >> 1, CASE WHEN xor(s, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) % 6 AS h FROM c
), r AS (
  SELECT h.conv_id, list_concat(coalesce(f.own[1:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN c f ON f.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, d AS depth, path[1:d] AS node, d = len(path) AS ends, CASE WHEN d > 0 THEN len(path[d].text) ELSE 0 END AS size FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM r)
), n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY node, depth
), k AS (
  SELECT node[1:depth - 1] AS parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
s AS (
  SELECT p.node, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.size) AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.node
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.node = m.node LEFT JOIN m u ON m.depth > 0 AND u.node = m.node[1:m.depth - 1]
"""
