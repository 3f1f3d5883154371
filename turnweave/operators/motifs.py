"""Three-turn motifs, conversation families, exact duplicates and rewired controls."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.labels import single_spaced, stripped, trusted
from turnweave.operators.graphs import components
from turnweave.operators.sinks import delete_folder, new_folder, staged
from turnweave.schema import Library

SEED = 577
#: Characters an utterance has at least.
LEAST = 20
#: A set is cut into at most so many subsets of one size; sets of more than SMALL utterances are not cut.
SUBSETS, SMALL = 50, 64
#: Rows of a staged table that may be broadcast.
BROADCAST = 200_000
#: Bits by which subsets are counted before they are named by 128.
SHORT = 40


def motifs(lib: Library) -> DataFrame:
    """(conv_id, key, nodes, at): two edges on exactly three turns, first occurrence of each key in a conversation; `at` numbers the edges.

    All edges count. The key holds the three actions, the speakers renamed within the motif
    and the relabelled edges. A pair of edges shares a turn, so pairs come from an equi-join
    on (conversation, turn) instead of all pairs of a conversation.
    """
    ends = lib.edges.select("conv_id", "ord", "source", "target", "type", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    left = ends.select("conv_id", "node", *[F.col(c).alias(f"a_{c}") for c in ("ord", "source", "target", "type")])
    right = ends.select("conv_id", "node", *[F.col(c).alias(f"b_{c}") for c in ("ord", "source", "target", "type")])
    pairs = left.join(right, ["conv_id", "node"]).where("a_ord < b_ord").drop("node").distinct()
    nodes = F.array_sort(F.array_distinct(F.array("a_source", "a_target", "b_source", "b_target")))
    pairs = pairs.withColumn("nodes", nodes).where("size(nodes) = 3")
    t = lib.turns.select("conv_id", "pos", "speaker", "action")
    for i in range(3):
        here = t.select("conv_id", F.col("pos").alias(f"p{i}"), F.col("speaker").alias(f"s{i}"), F.col("action").alias(f"x{i}"))
        pairs = pairs.withColumn(f"p{i}", F.get("nodes", F.lit(i))).join(here, ["conv_id", f"p{i}"])
    edge = lambda e: f"struct(cast(array_position(nodes, {e}_source) - 1 AS INT) AS source, cast(array_position(nodes, {e}_target) - 1 AS INT) AS target, {e}_type AS type)"
    voices = "array('S1', CASE WHEN s1 = s0 THEN 'S1' ELSE 'S2' END, CASE WHEN s2 = s0 THEN 'S1' WHEN s2 = s1 THEN 'S2' WHEN s1 = s0 THEN 'S2' ELSE 'S3' END)"
    shown = f"transform(array_sort(array({edge('a')}, {edge('b')})), e -> concat(e.source, '>', e.target, ':', e.type))"
    key = f"concat_ws('|', array_join(array(x0, x1, x2), ','), array_join({voices}, ','), array_join({shown}, ','))"
    keyed = pairs.select("conv_id", F.expr(key).alias("key"), "nodes", F.struct("a_ord", "b_ord").alias("at"))
    return keyed.groupBy("conv_id", "key").agg(F.min_by("nodes", "at").alias("nodes"), F.min("at").alias("at"))


def motif_index(found: DataFrame) -> DataFrame:
    """(key, conversations): in how many conversations each motif occurs."""
    return found.groupBy("key").agg(F.countDistinct("conv_id").alias("conversations"))


def motif_queries(found: DataFrame, index: DataFrame, least: int = 2, most: int = 100, limit: int = 200, seed: int = SEED) -> DataFrame:
    """(conv_id, key): one hash-chosen eligible motif of each conversation, in a hash order, up to `limit`."""
    good = found.join(index.where(F.col("conversations").between(least, most)), "key")
    chosen = good.groupBy("conv_id").agg(F.min_by("key", F.xxhash64(F.lit(seed), "conv_id", "key")).alias("key"))
    return chosen.orderBy(F.xxhash64(F.lit(seed), "conv_id")).limit(limit)


def utterances(turns: DataFrame, least: int = LEAST) -> DataFrame:
    """(conv_id, utterance): distinct single-spaced lower-case texts of `least` characters or more without outer white space."""
    return turns.where(F.length(stripped(F.col("text"))) >= least).select("conv_id", single_spaced(F.lower("text")).alias("utterance")).distinct()


def utterance_sets(turns: DataFrame, least: int) -> DataFrame:
    """(conv_id, s): hashes of a conversation's distinct utterances where there are `least` or more."""
    own = turns.where(F.length(stripped(F.col("text"))) >= LEAST).groupBy("conv_id")
    return own.agg(F.array_sort(F.collect_set(F.xxhash64(single_spaced(F.lower("text"))))).alias("s")).where(F.size("s") >= least)


def name(utterances: str, x: str = "0L", y: str = "0L") -> list:
    """128 bits (x, y) that name a set: those of another set where `utterances` are put in or left out, which are the same in exclusive or."""
    return [F.expr(f"aggregate({utterances}, {x}, (a, v) -> a ^ v)").alias("x"), F.expr(f"aggregate({utterances}, {y}, (a, v) -> a ^ xxhash64(v))").alias("y")]


def needed(n: int, shared: int, part: float) -> int:
    """How many utterances a set of `n` and one at least as large must share."""
    return max(shared, math.ceil(part * n))


def cuts(sizes: list[int], shared: int, part: float) -> tuple[list[tuple], dict[int, int]]:
    """Rows (n, own, places) of what to leave out of sets of `n` in turn, and by size up to which size its partners are found by that.

    Own rows leave as many utterances as a set of `n` itself needs, others as many as a smaller one that occurs needs.
    """
    rows, reach = [], {}
    for n in sizes:
        k = needed(n, shared, part)
        reach[n] = max((m for m in range(n, SMALL + 1) if math.comb(m, k) <= SUBSETS), default=n - 1)
    for n in sizes:
        for k in {needed(m, shared, part) for m in sizes if m <= n <= reach[m]}:
            rows += [(n, k == needed(n, shared, part), list(c)) for c in itertools.combinations(range(n), n - k)]
    return rows, reach


def few(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def links(heads: DataFrame, folder: str, shared: int = 4, part: float = 0.8) -> DataFrame:
    """(a, b): ids of different sets (id, s, n, x, y) that share at least `shared` utterances and `part` of the smaller one; whoever is linked by all such pairs is linked by these.

    Of sets that hold the same k utterances, the smallest is linked with each of them if k is
    what it needs, which is what all their pairs come to. So sets of few utterances meet by their subsets of k, rows grow
    with the sets and no pairs are compared. Sets with too many subsets meet by an equi-join:
    a set must share one of its n - k + 1 rarest utterances.
    """
    spark = heads.sparkSession
    held = sorted(r["n"] for r in heads.select(F.least("n", F.lit(SMALL + 1)).alias("n")).distinct().collect())
    rows, reach = cuts([n for n in held if n <= SMALL], shared, part)
    found = [] if not rows else [_by_subsets(heads, F.broadcast(spark.createDataFrame(rows, "n int, own boolean, places array<int>")), folder)]
    far = {n: m for n, m in reach.items() if m < held[-1]}
    if far or held[-1:] == [SMALL + 1]:
        found.append(_by_rarest(heads, far, folder, shared, part))
    return functools.reduce(DataFrame.union, found, spark.createDataFrame([], "a long, b long"))


def _by_subsets(heads: DataFrame, cut: DataFrame, folder: str) -> DataFrame:
    """(a, b): each set and the smallest that needs no more than the subset both hold."""
    held = heads.join(cut, "n").select("id", "n", "own", *name("transform(places, i -> s[i])", "x", "y"))
    guested = cut.where("NOT own").select((F.col("n") - F.size("places")).alias("k")).distinct()
    sized = cut.where("own").select("n", (F.col("n") - F.size("places")).alias("k")).distinct().join(guested.withColumn("guests", F.lit(True)), "k", "left")
    # most subsets have one holder: SHORT bits of each are counted first, and only those that then occur twice or can have guests are named in full
    short = F.shiftright("x", 64 - SHORT)
    twice = staged(held.where("own").groupBy(short.alias("short")).agg(F.count("*").alias("c")).where("c > 1").select("short"), folder)
    own = held.where("own")
    if twice.count() <= BROADCAST:
        hosts = F.broadcast(sized.where("guests").select("n", F.lit(True).alias("host")))
        own = own.withColumn("short", short).join(F.broadcast(twice.withColumn("again", F.lit(True))), "short", "left").join(hosts, "n", "left").where("again OR host")
    # one long that orders by size, then id, so that the minimum needs no sort
    own = own.groupBy("x", "y").agg(F.min(F.expr("shiftleft(cast(n AS BIGINT), 56) | id")).alias("code"), F.count("*").alias("c"))
    own = own.withColumns({"n": F.shiftright("code", 56).cast("int"), "a": F.expr(f"code & {2**56 - 1}L")})
    centres = staged(own.join(F.broadcast(sized), "n").where("c > 1 OR guests").select("x", "y", "a", "c", "guests"), folder)
    among = held.where("own").join(few(centres.where("c > 1")), ["x", "y"])
    guests = held.where("NOT own").join(few(centres.where("guests")), ["x", "y"])
    return among.select("a", F.col("id").alias("b")).union(guests.select("a", F.col("id").alias("b"))).where("a <> b")


def _by_rarest(heads: DataFrame, far: dict[int, int], folder: str, shared: int, part: float) -> DataFrame:
    """(a, b): pairs of a set and one larger than `far` says for its size, or for sizes above SMALL any that is as large."""
    spark = heads.sparkSession
    need = F.greatest(F.lit(shared), F.ceil(F.lit(part) * F.col("n"))).cast("int")
    table = F.broadcast(spark.createDataFrame(list(far.items()), "n int, far int"))
    asked = heads.join(table, "n", "left").where(f"far IS NOT NULL OR n > {SMALL}")
    asked = staged(asked.select("id", "s", "n", F.coalesce("far", F.col("n") - 1).alias("far"), need.alias("need")), folder)
    there = heads.where(F.col("n") > min([SMALL, *far.values()])).select("id", "n", F.explode("s").alias("u"))
    terms = staged(asked.select(F.explode("s").alias("u")).distinct(), folder)
    freq = staged(there.join(few(terms), "u").groupBy("u").agg(F.count("*").alias("f")), folder)
    spread = asked.select("id", "n", "far", "need", F.explode("s").alias("u")).join(freq, "u", "left")
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("f", F.lit(0)), "u")))
    probe = staged(ranked.where("r <= n - need + 1 AND f IS NOT NULL").select("u", F.col("id").alias("a"), F.col("n").alias("a_n"), "far"), folder)
    met = few(probe).join(there.select("u", F.col("id").alias("b"), F.col("n").alias("b_n")), "u").where("b_n > far AND (a_n < b_n OR a < b)")
    pairs = staged(met.select("a", "b").distinct(), folder)
    pairs = pairs.join(asked.select(F.col("id").alias("a"), F.col("s").alias("a_s"), "need"), "a")
    met = staged(pairs.select("b").distinct(), folder)
    pairs = pairs.join(heads.select(F.col("id").alias("b"), F.col("s").alias("b_s")).join(few(met), "b", "left_semi"), "b")
    return pairs.where("size(array_intersect(a_s, b_s)) >= need").select("a", "b")


def families(turns: DataFrame, shared: int = 4, part: float = 0.8) -> DataFrame:
    """(conv_id, family): the smallest conversation of each family of near-duplicate conversations.

    Conversations are similar if they share at least `shared` utterances and `part` of the smaller
    set. Equal sets are one node of the graph. Utterances are compared by 64 bits of hash, sets and subsets by 128.
    """
    folder = new_folder(turns.sparkSession)
    stored = staged(utterance_sets(turns, shared).withColumn("id", F.monotonically_increasing_id()), folder)
    sets = stored.select("id", "s", F.size("s").alias("n"), *name("s"))  # names are made anew at each reading, not stored
    equal = staged(sets.groupBy("x", "y").agg(F.min("id").alias("head"), F.count("*").alias("c")).where("c > 1").drop("c"), folder)
    copies = staged(sets.select("id", "x", "y").join(few(equal), ["x", "y"]).where("id <> head").select("id", "head"), folder)
    heads = sets.join(few(copies), "id", "left_anti")
    if copies.count() > BROADCAST:
        heads = staged(heads, folder)
    linked = components(links(heads, folder, shared, part), folder).withColumnRenamed("node", "id")
    # whoever is not alone: linked sets, then sets that have copies and the copies, by the component of the set or else the set itself
    alike = copies.select("head", "id").union(copies.select("head", F.col("head").alias("id")).distinct())
    alike = alike.join(linked.withColumnRenamed("id", "head"), "head", "left").select("id", F.coalesce("component", "head").alias("component"))
    members = staged(linked.union(alike).distinct(), folder)
    members = staged(stored.select("id", "conv_id").join(few(members), "id").select("conv_id", "component"), folder)
    least = staged(members.groupBy("component").agg(F.min("conv_id").alias("family")), folder)
    named = staged(members.join(few(least), "component").select("conv_id", "family"), folder)
    every = turns.select("conv_id").distinct().join(few(named), "conv_id", "left")
    found = staged(every.select("conv_id", F.coalesce("family", "conv_id").alias("family")))
    delete_folder(turns.sparkSession, folder)
    return found


def family_filter(turns: DataFrame, split: DataFrame) -> DataFrame:
    """(conv_id, split, kept) for (conv_id, split, ordinal): the first of a family stays, train before test."""
    rows = split.join(families(turns), "conv_id").withColumn("rank", F.struct((F.col("split") != "train").alias("late"), "ordinal"))
    heads = rows.groupBy("family").agg(F.min("rank").alias("first"))
    return rows.join(heads, "family").select("conv_id", "split", (F.col("rank") == F.col("first")).alias("kept"))


def digest(turns: DataFrame) -> DataFrame:
    """(conv_id, digest): SHA-256 of the lower-case texts without outer white space, joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", stripped(F.lower(F.coalesce("text", F.lit("")))).alias("t"))))
    return turns.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), " "), 256).alias("digest"))


def drop_exact_duplicates(turns: DataFrame, split: DataFrame) -> DataFrame:
    """Test conversations whose digest no training conversation has."""
    d = split.join(digest(turns), "conv_id")
    train = d.where("split = 'train'").select("digest")
    return d.where("split <> 'train'").join(train, "digest", "left_anti").select("conv_id")


def rewired(episodes: DataFrame, seed: int = SEED) -> DataFrame:
    """`episodes` that have a re-routable edge, with `rewired`: the trusted edges after the first such edge, trusted or not, answers another earlier turn."""
    at = "array_position(transform(edges, e -> e.source >= 2 OR (e.source = 1 AND e.target <> 0)), true)"
    other = f"filter(sequence(0, greatest(edges[{at} - 1].source - 1, 0)), i -> i <> edges[{at} - 1].target)"
    pick = f"element_at({other}, cast(pmod(xxhash64({seed}, conv_id, start), size({other})) + 1 AS INT))"
    moved = f"transform(edges, (e, i) -> CASE WHEN i = {at} - 1 THEN struct(e.ord, e.source, {pick} AS target, e.type, e.provenance) ELSE e END)"
    return episodes.where(f"{at} > 0").withColumn("rewired", F.expr(f"filter({moved}, e -> {trusted('e.provenance')})"))
