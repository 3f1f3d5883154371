"""MinHash near-dedup with BagMinHash signatures over multisets of word shingles.

A document is the multiset of its runs of five words (a text of one to four words is
one shingle). Two documents are near duplicates when their weighted Jaccard similarity
(sum of minima over sum of maxima of the counts) is at least `threshold`.

BagMinHash: every (shingle, weight interval) has a Poisson process of points, each with
a time, a signature slot and a weight level; a slot keeps the earliest time among the
points whose level lies below the shingle's count. Counts are discretised to integers
and the intervals double ([0,1), [1,2), [2,4), ...), so a count of w touches about
log2(w) processes, and points past the document's stop time are never drawn. Two slots
are equal with a probability that is the weighted Jaccard similarity.

Edge cases: null and wordless texts link with nothing; texts with equal words form one
node whatever their number; rows with a null id take part and are only chosen to stay
if no row of their class has an id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnweave.llm.bytewords import Words, mix, slices, times, with_columns
from turnweave.llm.components import components
from turnweave.llm.rowkeys import HASH, ID, with_key
from turnweave.llm.sieve import marked, sieve, sifted
from turnweave.llm.storage import Workspace, materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 26
ROWS = 5
TILE_BYTES = 1 << 19


def signatures(doc: np.ndarray, shingle: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """(n_docs, slots) BagMinHash times of the multisets of (doc, shingle); inf for an empty multiset."""
    order = np.lexsort((shingle, doc))
    d, h = doc[order], shingle[order]
    head = np.ones(len(d), bool)
    head[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    place = np.flatnonzero(head)
    weight = np.diff(np.append(place, len(d)))
    d, h = d[place], h[place]
    items = [(d, mix(h), np.ones(len(d)), np.zeros(len(d)), weight)]
    k = 1
    while len(weight) and (heavy := weight > (low := 1 << (k - 1))).any():
        n = int(heavy.sum())
        items.append((d[heavy], mix(h[heavy] + times(k, 0xD1342543DE82EF95)), np.full(n, float(low)), np.full(n, float(low)), weight[heavy]))
        k += 1
    doc_i, seed, rate, low_i, weight_i = (np.concatenate(x) for x in zip(*items, strict=True))
    total = np.bincount(doc, minlength=n_docs).astype(float)
    out = np.full(n_docs * slots, np.inf)
    todo, slack = total > 0, 4.0
    while todo.any():
        stop = np.where(todo, (np.log(slots) + slack) / np.maximum(total, 1), -1.0)
        use = np.flatnonzero(todo[doc_i])
        _fill(out, stop, doc_i[use], seed[use], rate[use], low_i[use], weight_i[use], slots)
        todo &= np.isinf(out.reshape(n_docs, slots)).any(axis=1)
        slack *= 3
    return out.reshape(n_docs, slots)


def _fill(out, stop, doc, seed, rate, low, weight, slots) -> None:
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        bits = mix(seed + times(2 * step, 0x9E3779B97F4A7C15))
        time = time - np.log(((bits >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / (slots * rate)
        live = time <= stop[doc]
        doc, seed, rate, low, weight, time = (x[live] for x in (doc, seed, rate, low, weight, time))
        bits = mix(seed + times(2 * step + 1, 0x9E3779B97F4A7C15))
        slot = ((bits >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        level = low + np.floor((bits & np.uint64(0xFFFFFFFF)) * 2.0**-32 * rate)
        taken = level < weight
        np.minimum.at(out, doc[taken] * slots + slot[taken], time[taken])


def _band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = mix(np.ascontiguousarray(times).view(np.uint64)).reshape(len(times), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (len(times), bands)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(31) + cells[:, :, r])
    return key.view(np.int64)


def _digests(words: Words) -> np.ndarray:
    """128 bits of each word sequence, as an (n_docs, 2) array."""
    h, n = words.hashes(), words.n_docs
    first = np.concatenate([[0], np.cumsum(words.count)])[:-1]
    place = (np.arange(len(h)) - first[words.doc]).astype(np.uint64)
    out = np.zeros((n, 2), np.uint64)
    for c, salt in enumerate((0x632BE59BD9B4E019, 0xE7037ED1A0B428DB)):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + (place + np.uint64(1)) * np.uint64(salt)))])
        out[:, c] = mix(running[first + words.count] - running[first])
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """One row per document: its key, `node` (digest of its words; null without words), `n` shingles and `bands` keys."""

    def make(texts: list[bytes]) -> list[pa.Array]:
        words = Words(texts)
        doc, shingle = words.shingles(size)
        n = np.bincount(doc, minlength=len(texts))
        keys = _band_keys(signatures(doc, shingle, len(texts), bands * rows), bands, rows)
        node = pa.array([d.tobytes() if k else None for d, k in zip(_digests(words), n, strict=True)], pa.binary())
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[n > 0].ravel()), mask=pa.array(n == 0))
        return [node, pa.array(n), lists]

    source = docs.select(*with_key(docs, id_col, text_col), docs[text_col].alias("text"))
    added = T.StructType.fromDDL("node binary, n long, bands array<long>")
    return with_columns(source, "text", added.fields, make).drop("text")


def _tokens(texts: DataFrame, size: int) -> DataFrame:
    """`tokens` of each node: one number for every shingle and its how-manieth occurrence, so that a multiset is a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, held in slices(batch.column("text")):
                doc, shingle = Words(held).shingles(size)
                order = np.lexsort((shingle, doc))
                d, h = doc[order], shingle[order]
                head = np.ones(len(d), bool)
                head[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                nth = np.arange(len(d)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                token = np.where(nth == 0, h, mix(h + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=b - a))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(token))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), lists], ["node", "tokens"])

    return texts.select("node", "text").mapInArrow(run, "node long, tokens array<long>")


def bridges(group: np.ndarray, block: np.ndarray, tokens: np.ndarray, ends: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows at `threshold` that join all groups which any such pair joins; rows are token sets tokens[ends[i]:ends[i + 1]].

    With two blocks, only rows of different blocks are compared: each block meets itself
    elsewhere. A row drops out beforehand if too few of its tokens occur in another group
    for any partner. Every other row is compared with all later rows at once, unless they
    are joined already, so that nothing but the row's counts is held.
    """
    n = np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    group = np.unique(group, return_inverse=True)[1]
    kinds, token = np.unique(tokens, return_inverse=True)
    low, high = np.full(len(kinds), len(n)), np.full(len(kinds), -1)
    np.minimum.at(low, token, group[row])
    np.maximum.at(high, token, group[row])
    shared = (low != high)[token]
    able = np.bincount(row[shared], minlength=len(n)) >= threshold * n - 1e-6  # of n + m - c >= c / threshold, the least over all sizes m
    able &= n > 0
    rows = np.flatnonzero(able)
    rows = rows[np.lexsort((np.bincount(group)[group[rows]], block[rows]))]  # small groups first: what joins them spares the large one's rows
    place = np.full(len(n), -1)
    place[rows] = np.arange(len(rows))
    use = shared & able[row]
    order = np.argsort(place[row[use]], kind="stable")
    token, row = token[use][order], place[row[use]][order]
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    group, n, block = group[rows], n[rows], block[rows]
    two = len(rows) > 0 and block[0] != block[-1]
    second = int(np.searchsorted(block, block[-1])) if two else len(rows)
    mark, found = np.zeros(len(kinds), bool), []
    for i in range(second if two else len(rows) - 1):
        start = second if two else i + 1
        apart = group[start:] != group[i]
        if not apart.any():
            continue
        own = token[ends[i] : ends[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[token[ends[start] :]].astype(np.int64), ends[start:-1] - ends[start])
        mark[own] = False
        for j in np.flatnonzero(apart & (common / (n[i] + n[start:] - common) >= threshold)) + start:
            if group[j] != group[i]:
                found.append((int(rows[i]), int(rows[j])))
                group[group == group[j]] = group[i]
    return found


def _tile(table: pa.Table, threshold: float) -> pa.Table:
    table = table.combine_chunks()
    lists, component = table.column("tokens").combine_chunks(), table.column("component").combine_chunks()
    tokens, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    group = component.dictionary_encode().indices.to_numpy()
    pairs = bridges(group, table.column("block").to_numpy(), tokens, ends, threshold)
    a, b = (component.take(pa.array([p[k] for p in pairs], pa.int64())) for k in (0, 1))
    return pa.table([a, b], ["a", "b"])


def _open_pairs(members: DataFrame, linked: DataFrame, tokens: DataFrame, threshold: float, tile_bytes: int) -> DataFrame:
    """(a, b): components joined by pairs of a bucket's members that are not its leader, all of which the leader was compared with.

    Members of buckets whose members lie in several components are dealt to `ceil(bytes / tile_bytes)`
    blocks a bucket, and every two blocks meet in one task, so a task holds about two blocks.
    """
    own = members.select("key", "node", "n").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n").alias("total")).where("low <> high")
    blocks = F.ceil(F.col("total") * 8 / tile_bytes).cast("int")
    rest = own.join(several.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rest.select("key", "node", "component", "block", "blocks").join(tokens, "node").select("key", "component", "block", "tokens", met)
    tiles = dealt.select("key", "component", "block", "tokens", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return tiles.groupBy("key", "i", "j").applyInArrow(lambda table: _tile(table, threshold), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """One row per document: its key, `head` (the row of its class that stays) and `kept`.

    1. Texts with equal words become one node.
    2. In each band bucket every member is verified against one leader, the least node,
       which is the same in all buckets that hold it: pairs repeat and collapse.
    3. Verified links give components. In buckets whose other members lie in several
       components, these are compared block by block (`bridges`), so no pair of a
       common bucket depends on its leader; only joined components are returned.
    4. Classes are the connected components of all links.
    Verification is the exact weighted Jaccard similarity of the whole texts' shingles. With 26
    bands of 5 slots a pair of similarity 0.8 shares no bucket with a probability of 3e-5.
    """
    space = Workspace(docs.sparkSession, "bagminhash")
    prints = space.table(fingerprints(docs, id_col, text_col, bands, rows, size), "prints")
    order = F.struct(F.col(ID).isNull().alias("none"), F.col(ID).alias("id"), F.col(HASH).alias("hash"))
    worded = prints.where("node is not null").withColumnRenamed("node", "digest")
    nodes = worded.groupBy("digest").agg(F.min(order).alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = space.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # short numbers from here on, fixed by being written

    buckets = nodes.select(F.explode("bands").alias("key"), "node", "n")
    heads = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1")
    heads = space.table(heads.select("key", "leader"), "heads")
    shared = space.table(sieve(heads, "key"), "shared-keys")  # most keys occur once; they do not enter the join
    members = space.table(sifted(buckets, "key", shared).join(heads, "key").where("node <> leader"), "members")

    wanted = members.select("node").union(heads.select("leader")).distinct()
    wanted = wanted.join(nodes.select("node", F.col("head.id").alias("w_id"), F.col("head.hash").alias("w_hash")), "node")
    wanted = space.table(wanted, "wanted")
    found = docs.select(*with_key(docs, id_col, text_col), docs[text_col].alias("text"))
    found = sifted(found, HASH, space.table(sieve(wanted, "w_hash"), "wanted-texts"))
    found = found.join(wanted, (F.col(HASH) == F.col("w_hash")) & F.col(ID).eqNullSafe(F.col("w_id")))
    tokens = space.table(_tokens(found.select("node", "text").dropDuplicates(["node"]), size), "tokens")

    asked = members.select("leader", "node", "n").distinct().join(nodes.select(F.col("node").alias("leader"), F.col("n").alias("leader_n")), "leader")
    asked = space.table(asked.where(F.least("n", "leader_n") / F.greatest("n", "leader_n") >= threshold), "asked")
    pairs = asked.join(tokens.withColumnRenamed("tokens", "held"), "node").join(tokens.select(F.col("node").alias("leader"), "tokens"), "leader")
    common = F.size(F.array_intersect("held", "tokens"))
    links = pairs.where(common / (F.col("n") + F.col("leader_n") - common) >= threshold).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    linked = components(links, space)

    more = space.table(_open_pairs(members, linked, tokens, threshold, tile_bytes), "bridges")
    joined = components(more, space).select(F.col("node").alias("component"), F.col("component").alias("root"))
    several = linked.unionByName(joined.select(F.col("component").alias("node"), "component")).distinct()  # a component is a node of its own
    several = several.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    several = space.table(nodes.select("node", "head").join(several, "node"), "joined")
    least = several.groupBy("component").agg(F.min("head").alias("class_head"))
    grouped = several.join(least, "component").select("node", "class_head")
    classes = nodes.select("node", "digest", "head").join(grouped, "node", "left").select(F.col("digest").alias("node"), F.coalesce("class_head", "head").alias("head"))
    out = prints.select(ID, HASH, "node").join(space.table(classes, "classes"), "node", "left")
    out = out.withColumn("head", F.coalesce("head", order))
    out = out.select(ID, HASH, "head", (F.col("head.id").eqNullSafe(F.col(ID)) & (F.col("head.hash") == F.col(HASH))).alias("kept"))
    return space.result(out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of `docs`, one of each class of near duplicates, with all their columns.

    The row with the smallest id stays; of rows repeated with the same id and text, one.
    Only texts whose hash is, by a table of bits, perhaps that of a key that goes or repeats
    enter a join; the others stay where they are read.
    """
    space = Workspace(docs.sparkSession, "bagminhash-keys")
    keys = near_duplicates(docs, id_col, text_col, **options).groupBy(F.col(ID).alias("__tw_k"), F.col(HASH).alias("__tw_h"))
    keys = keys.agg(F.first("kept").alias("kept"), F.count("*").alias("times")).where("not kept or times > 1")
    keys = space.result(keys)
    keyed = marked(docs.select("*", *with_key(docs, id_col, text_col)), HASH, materialise(sieve(keys, "__tw_h"), "bagminhash-sieve"))
    same = (F.col(HASH) == F.col("__tw_h")) & F.col(ID).eqNullSafe(F.col("__tw_k"))
    doubtful = keyed.where("__tw_met")
    once = keyed.where("NOT __tw_met").unionByName(doubtful.join(keys, same, "left_anti"))
    repeated = keys.where("kept")
    if repeated.limit(1).count():
        once = once.unionByName(doubtful.join(repeated, same, "left_semi").dropDuplicates([ID, HASH]))
    return once.drop(ID, HASH, "__tw_met")
