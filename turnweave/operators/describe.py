"""The nineteen descriptors of an episode, its measures, flags and response pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.labels import entropy, move_group, words


def described(episodes: DataFrame) -> DataFrame:
    """`episodes` with descriptors, measures, `flags` and `pairs`; each step is an expression over the row."""
    share = lambda move: f"size(filter(labels, m -> m = '{move}')) / n"
    out = episodes.withColumns({
        "n": F.expr("size(turns)"),
        "labels": F.expr(f"transform(turns, t -> {move_group('t.action')})"),
        "voices": F.expr("transform(turns, t -> t.speaker)"),
        "bags": F.expr(f"transform(turns, t -> {words('t.text')})"),
        "lags": F.expr("transform(trusted, e -> abs(e.source - e.target))"),
        "targets": F.expr("transform(trusted, e -> e.target)"),
    }).withColumns({
        "m": F.expr("size(trusted)"),
        "speakers": F.expr("size(array_distinct(voices))"),
        "far": F.expr("size(filter(lags, x -> x > 1))"),
        "branch": F.expr("size(filter(array_distinct(targets), x -> size(filter(targets, y -> y = x)) >= 2))"),
        "mean_lag": F.expr("CASE WHEN size(lags) > 0 THEN aggregate(lags, 0D, (a, x) -> a + x) / size(lags) END"),
        "sets": F.expr("transform(bags, b -> array_distinct(b))"),
        "gaps": F.expr("greatest(1, n - 1)"),
    }).withColumns({
        "log_turns": F.expr("log1p(n)"),
        "speaker_fraction": F.expr("speakers / n"),
        "speaker_switching": F.expr("size(filter(sequence(0, n - 1), i -> i > 0 AND voices[i] <> voices[greatest(i - 1, 0)])) / gaps"),
        "speaker_entropy": F.expr(entropy("voices")),
        "largest_speaker_share": F.expr("array_max(transform(array_distinct(voices), v -> size(filter(voices, w -> w = v)))) / n"),
        "known_action_fraction": F.expr(f"1 - {share('unknown')}"),
        "target_density": F.expr("m / n"),
        "nonadjacent_fraction": F.expr("far / greatest(1, m)"),
        "mean_target_span": F.expr("coalesce(mean_lag, 0D) / gaps"),
        "max_target_span": F.expr("coalesce(array_max(lags), 0) / gaps"),
        "branching_targets": F.expr("branch / n"),
        "clarification_fraction": F.expr(share("clarify")),
        "answer_fraction": F.expr(share("answer")),
        "question_fraction": F.expr(share("question")),
        "acknowledgement_fraction": F.expr(share("acknowledge")),
        "proposal_fraction": F.expr(share("propose")),
        "action_entropy": F.expr(entropy("labels")),
        "mean_log_word_count": F.expr("aggregate(bags, 0D, (a, b) -> a + log1p(size(b))) / n"),
        "lexical_recurrence": F.expr(
            "aggregate(transform(slice(sets, 1, n - 1), (s, i) -> size(array_intersect(s, sets[i + 1])) / greatest(1, size(array_union(s, sets[i + 1])))), 0D, (a, x) -> a + x) / gaps"
        ),
        "reach": F.expr("round(mean_lag, 3)"),
        "flags": F.expr("cast(speakers >= 3 AS INT) + 2 * cast(far > 0 AS INT) + 4 * cast(array_contains(labels, 'clarify') AS INT) + 8 * cast(branch > 0 AS INT) + 16 * cast(m > 0 AS INT)"),
        "pairs": F.expr("transform(trusted, e -> struct(labels[e.target] AS from_move, labels[e.source] AS to_move))"),
    })
    out = out.withColumns({"switch": F.expr("round(speaker_switching, 4)"), "known": F.expr("round(known_action_fraction, 4)")})
    return out.withColumnsRenamed({"n": "turn_count", "m": "edge_count", "far": "nonadjacent"}).drop("labels", "voices", "bags", "lags", "targets", "sets", "gaps", "mean_lag")


def pair_census(rows: DataFrame) -> DataFrame:
    """(corpus, from_move, to_move, n, place): pairs of every episode, most frequent first, ties by first encounter
    in the order of conversation ids, starts and edges.

    Overlapping episodes count a link each, by design. The first encounter is a minimum,
    so no list of encounters is gathered.
    """
    from pyspark.sql import Window

    every = rows.select("corpus", "conv_id", "start", F.posexplode("pairs").alias("k", "p"))
    counted = every.groupBy("corpus", F.col("p.from_move").alias("from_move"), F.col("p.to_move").alias("to_move"))
    counted = counted.agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "start", "k")).alias("first"))
    place = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("n"), "first"))  # at most 169 rows a corpus
    return counted.select("corpus", "from_move", "to_move", "n", place.alias("place"))


def first_examples(rows: DataFrame) -> DataFrame:
    """(corpus, episode_id): the last small group episode with a clarification, else the first episode."""
    good = "(flags & 4) > 0 AND (flags & 1) > 0 AND turn_count <= 10"
    return rows.groupBy("corpus").agg(
        F.expr(f"coalesce(max_by(episode_id, struct(conv_id, start)) FILTER (WHERE {good}), min_by(episode_id, struct(conv_id, start)))").alias("episode_id")
    )


def pair_episode(rows: DataFrame, corpus: str, from_move: str, to_move: str) -> DataFrame:
    """The episode that shows a pair best: most speakers, fewest turns, smallest id."""
    pair = F.struct(F.lit(from_move).alias("from_move"), F.lit(to_move).alias("to_move"))
    return rows.where((F.col("corpus") == corpus) & F.array_contains("pairs", pair)).orderBy(F.desc("speakers"), "turn_count", "episode_id").limit(1)
