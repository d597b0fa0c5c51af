"""Op 4, MinHash near-dedup with tensored banding.

Two collections of `half` keys each, a key made of `rows` minhashes, take 2 * half * rows minhashes; pairing every key of one
collection with every key of the other gives half * half tables, as strict as 2 * rows minhashes each.  `half` is chosen so
that a pair at the threshold is missed with a probability under 1e-6 for each collection.

1. Equal shingle sets form a class (by a 128-bit sum of their hashes); its smallest id stands for it.
2. Keys of one collection held by a single class can't collide in any table: they go before the tables are formed.
3. Table keys shared by two classes or more tie them into families; ties are (class, smallest class of the table key).
4. Each family's full shingle sets meet once, in one task, where exact intersections over an inverted index give the links.
   Families over `block` shingles are cut into blocks, every two of which meet in a task of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import textarrays as ta
from quantloom.llm.common import documents, dropped, partitions_for, small_batches, text_fingerprint, written
from quantloom.llm.components import connected_components

SHINGLE, THRESHOLD, ROWS = 3, 85, 3
#: Shingles (8 bytes each) of one verification task.
BLOCK = 600_000
#: Ids that are broadcast at most (8 bytes each); beyond, the same join shuffles.
BROADCAST_IDS = 1_000_000


def half_keys(threshold: int, rows: int = ROWS, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (threshold / 100) ** rows))


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row, one after another, and the rows' offsets."""
    data, offsets = ta.text_buffers(column)
    n = len(column)
    starts, ends, row = ta.word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    codes, words = ta.coded(*ta.packed(ta.lowered(data), starts, ends))
    h = ta.word_hashes(words)[codes]
    whole = np.zeros(0, bool)
    grams = ta.rolling(h, k)
    if len(grams):
        whole = row[: len(grams)] == row[k - 1 :]
    count = np.bincount(row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    own, owner = [grams[whole]], [row[: len(grams)][whole]]
    first = np.cumsum(count) - count
    for size in range(1, k):  # fewer words than a shingle: the whole sequence is one
        r = short[count[short] == size]
        if len(r):
            value = np.full(len(r), size, np.uint64)
            for t in range(size):
                value = ta.mix(value * ta.SEQ + h[first[r] + t])
            own.append(value)
            owner.append(r)
    sets, owner = np.concatenate(own), np.concatenate(owner)
    order = np.lexsort((sets, owner))
    sets, owner = sets[order], owner[order]
    keep = np.ones(len(sets), bool)
    keep[1:] = (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])
    sets, owner = sets[keep], owner[keep]
    return sets, np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


def _signatures(k: int, rows: int, half: int):
    """mapInArrow: (doc, text) to doc, n_shingles, set1, set2 (128 bits of the set), keys (2 * half table half-keys)."""
    seeds = np.random.default_rng(20240601).integers(1, 1 << 63, 2 * half * rows, dtype=np.uint64) | np.uint64(1)

    def work(batches):
        for whole in batches:
            for batch in ta.slices(whole, 1):
                sets, offsets = shingle_sets(batch.column(1), k)
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                at = offsets[:-1][full]
                keys = np.zeros((len(full), 2 * half), np.uint64)
                ident = np.zeros((2, len(full)), np.uint64)
                if len(full):
                    ident[0] = np.add.reduceat(ta.mix(sets ^ np.uint64(0xA5A5)), at)
                    ident[1] = np.add.reduceat(ta.mix(sets * np.uint64(0xD6E8FEB86659FD93)), at)
                    for j in range(2 * half):
                        value = np.full(len(full), j + 1, np.uint64)
                        for r in range(rows):
                            x = (sets ^ (sets >> np.uint64(31))) * seeds[j * rows + r]
                            x ^= x >> np.uint64(32)
                            value = value * ta.SEQ + ta.mix(np.minimum.reduceat(x * np.uint64(0xFF51AFD7ED558CCD), at))
                        keys[:, j] = ta.mix(value)
                out = [batch.column(0).take(pa.array(full)), pa.array(size[full], pa.int64()), pa.array(ident[0].view(np.int64)), pa.array(ident[1].view(np.int64))]
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, 2 * half), pa.int32()), pa.array(keys.ravel().view(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["doc", "n_shingles", "set1", "set2", "keys"])

    return work


def _set_rows(k: int):
    """mapInArrow: (doc, text, family) to doc, family, n, shingles (8 bytes each)."""

    def work(batches):
        for whole in batches:
            for batch in ta.slices(whole, 1):
                sets, offsets = shingle_sets(batch.column(1), k)
                raw = sets.tobytes()
                blobs = [raw[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(blobs, pa.binary())], names=["doc", "family", "n", "shingles"])

    return work


def link_sets(doc: np.ndarray, family: np.ndarray, sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Smallest doc of each row's component, among rows of one family linked at 100 * intersection >= threshold * union, exactly.

    Each set is held against all others that share a shingle with it, by counting over an inverted index; a family that has become
    one component needs no more counting.
    """
    n = len(doc)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    values, code = np.unique(flat, return_inverse=True)
    by = np.argsort(code, kind="stable")
    posting, at = owner[by], np.append(0, np.cumsum(np.bincount(code, minlength=len(values))))
    first = np.cumsum(size) - size
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    _, fam = np.unique(family, return_inverse=True)
    open_parts = np.bincount(fam)  # components left in each family
    weight = np.add.reduceat(np.diff(at)[code], first) / size  # likely hubs first
    for x in np.argsort(-weight, kind="stable").tolist():
        if open_parts[fam[x]] < 2:
            continue
        c = code[first[x] : first[x] + size[x]]
        others = posting[ta.ranges(at[c], at[c + 1] - at[c])]
        both = np.bincount(others, minlength=n) if len(others) * 4 > n else None
        if both is None:
            near, both = np.unique(others, return_counts=True)
        else:
            near = np.flatnonzero(both)
            both = both[near]
        for y in near[(100 * both >= threshold * (size[x] + size[near] - both)) & (fam[near] == fam[x])].tolist():
            a, b = root(x), root(y)
            if a != b:
                if doc[a] > doc[b]:
                    a, b = b, a
                parent[b] = a
                open_parts[fam[x]] -= 1
    return doc[np.array([root(x) for x in range(n)])]


def _verified(threshold: int):
    """applyInArrow on a task's rows: (doc, component)."""

    def work(table: pa.Table) -> pa.Table:
        doc, family = (table.column(c).to_numpy() for c in ("doc", "family"))
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("shingles")]
        component = link_sets(doc, family, sets, threshold)
        ta.give_back()  # the index of the task is gone
        return pa.table({"doc": pa.array(doc, pa.int64()), "component": pa.array(component, pa.int64())})

    return work


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (smallest id reachable over links, itself included), kept (id = component_id).

    Links are pairs with 100 * intersection >= threshold * union of their sets of `shingle`-word shingles, A-Z lower-cased. Null, empty and
    wordless texts have an empty set and no link. Rows that repeat an id share that id's component, each with its own set's size; where their texts differ,
    both texts' links count for the id. A row without id takes no part: component_id null, kept true. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    half = half_keys(threshold, rows)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    sig = written(source.where("doc IS NOT NULL").mapInArrow(_signatures(shingle, rows, half), "doc bigint, n_shingles bigint, set1 bigint, set2 bigint, keys array<bigint>"), "signatures")
    # classes of equal sets, each with its smallest id
    classes = sig.groupBy("set1", "set2").agg(F.min("doc").alias("cid"))
    member = written(sig.select("doc", "n_shingles", "set1", "set2").join(classes, ["set1", "set2"]).select("doc", "n_shingles", "cid"), "members")
    leads = sig.join(classes.select(F.col("cid").alias("doc"), "set1", "set2"), ["doc", "set1", "set2"], "left_semi")
    keys = leads.select("doc", F.posexplode("keys").alias("slot", "key")).distinct()
    keys = written(keys, "half-keys")
    dropped(sig)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    mine = keys.join(shared, "key").groupBy("doc").agg(*[F.collect_set(F.when(c, F.col("key"))).alias(n) for n, c in (("a", F.col("slot") < half), ("b", F.col("slot") >= half))])  # half keys each at most, but for ids that repeat
    tables = mine.select("doc", F.explode("a").alias("x"), "b").select("doc", "x", F.explode("b").alias("y")).select("doc", F.xxhash64("x", "y").alias("key"))
    tables = written(tables, "tables")
    dropped(keys)
    low = tables.groupBy("key").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low")
    ties = tables.join(low, "key").where("doc <> low").select(F.col("doc").alias("u"), F.col("low").alias("v")).distinct()
    family = written(connected_components(ties).select(F.col("node").alias("doc"), F.col("component").alias("family")), "families")
    dropped(tables)
    links = _links(source, family, shingle, threshold, block)
    # ids whose classes are linked, then ids that hold several classes
    found = member.select("doc", "cid").where("doc <> cid").select(F.col("doc").alias("u"), F.col("cid").alias("v")).unionByName(links)
    comp = written(connected_components(found), "components").withColumnsRenamed({"node": "doc", "component": "component_id"})
    sized = source.select("doc").where("doc IS NULL").select("doc", F.lit(0).cast("bigint").alias("n_shingles")).unionByName(member.select("doc", "n_shingles"))
    # rows without a set are not among the signatures
    empty = source.where("doc IS NOT NULL").where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("doc", F.lit(0).cast("bigint").alias("n_shingles"))
    out = sized.unionByName(empty).join(comp, "doc", "left").withColumn("component_id", F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(source: DataFrame, family: DataFrame, shingle: int, threshold: int, block: int) -> DataFrame:
    """u, v: edges that span the linked classes of each family."""
    n = family.count()
    side = F.broadcast(family) if n <= BROADCAST_IDS else family
    sets = source.join(side, "doc").select("doc", "text", "family").mapInArrow(_set_rows(shingle), "doc bigint, family bigint, n bigint, shingles binary")
    sets = written(sets, "sets")
    load = sets.groupBy("family").agg(F.sum("n").alias("load"))
    total = load.agg(F.sum("load").alias("s")).first()["s"] or 0
    tasks = partitions_for(total, block // 2)
    large = written(load.where(F.col("load") > block).select("family", F.ceil(F.col("load") / F.lit(block // 2)).cast("int").alias("blocks")), "large-families")
    schema = "doc bigint, component bigint"
    # small families: many to a task
    small = sets.join(large, "family", "left_anti").withColumn("task", F.pmod(F.xxhash64("family"), F.lit(tasks)))
    out = small.groupBy("task").applyInArrow(_verified(threshold), schema)
    if not large.isEmpty():
        # every two blocks of a large family meet in a task
        mine = F.pmod(F.xxhash64("doc"), F.col("blocks"))
        spread = sets.join(large, "family").withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = spread.select("doc", "family", "shingles", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        out = out.unionByName(spread.groupBy("family", "i", "j").applyInArrow(_verified(threshold), schema))
    links = written(out.where("doc <> component").select(F.col("doc").alias("u"), F.col("component").alias("v")), "links")
    dropped(sets)
    return links


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest id; all columns as they are.

    Where ids repeat or are null, rows are told apart by id and text: of one id the smaller fingerprint comes first, null ids come last. Rows alike in
    both stay or go together.
    """
    if docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        gone = near_components(docs, id_col, text_col, shingle, threshold).where("NOT kept").select(id_col).distinct()
        return docs.join(gone, id_col, "left_anti")
    mark = text_fingerprint(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("__id"), mark.alias("__mark"), F.col(text_col).alias("text")).dropDuplicates(["__id", "__mark"])
    order = [F.col("__id").asc_nulls_last(), F.col("__mark")]
    # ids of partitions by range, sorted: their order is the order of the rows
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "keyed")
    gone = near_components(rows, "key", "text", shingle, threshold).where("NOT kept").select("key")
    gone = written(rows.select("key", "__id", "__mark").join(gone, "key", "left_semi").select("__id", "__mark"), "near-copies")
    dropped(rows)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (mark == gone["__mark"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.v FROM r JOIN l ON l.u = r.y),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
