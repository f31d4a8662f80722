"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

Sources share the size of the whole by weight, none above ``most`` times its own size.  Documents are
dealt to shards by a hash; a shard of a source is a sequence of its documents in seeded order, cut
into blocks of (almost) ``block`` words.  As many blocks as the targets hold are given to the sources
one by one to the highest quotient votes / (2 k + 1), k being the blocks a source has, then those of a
source to its shards in the same way, never more than ``most`` times the blocks there are.  A shard with B blocks
and a quota of Q takes every block Q div B times and Q mod B of them, from a seeded one onwards, once more.

Nothing is dealt block by block: the quotients that can win are bounded from both sides, so a few
for each party are ranked, and the words a document gives follow from its place in its shard.
Rows meet only the rows of their own shard.  Single tasks see one row for each source (then for each shard
of a source), never documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def capped_shares(sources: DataFrame, most: int) -> DataFrame:
    """``sources`` (weight, words) with target: shares of all words by weight, none above most * words.

    A source is at its limit if its limit for a unit of weight is below the level at which the rest share
    what is left; taken in that order, the level is found in one pass.
    """
    limit = most * F.col("words")
    whole, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("_limit") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("words").over(whole) - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    placed = sources.withColumn("_limit", limit).withColumn("_level", level).withColumn("_held", F.col("_limit") <= F.col("_level") * F.col("weight"))
    # the first source below its limit sets the level of all that follow
    free = F.min(F.when(~F.col("_held"), F.struct(F.col("_limit") / F.col("weight"), "rank", "_level"))).over(whole)["_level"]
    return placed.withColumn("_free", free).withColumn("target", F.coalesce(F.least(F.col("_limit").cast("double"), F.col("weight") * F.col("_free")), F.col("_limit").cast("double"))).drop("_limit", "_level", "_held", "_free")


def apportioned(parties: DataFrame, group: list[str], order: list[str], seats: str) -> DataFrame:
    """``parties`` (votes double, bound long) with ``quota``: ``seats`` of each group by highest quotients votes / (2 k + 1).

    Of equal quotients the party first in ``order`` comes first; no party gets more than ``bound``, which is at least its votes.  A
    divisor that gives no seat too many and one that gives all of them bound the quotas; only quotients between are ranked.
    """
    one = Window.partitionBy(*(group or [F.lit(0)]))
    votes, n = F.sum("votes").over(one), F.count(F.lit(1)).over(one)
    at = lambda total: F.floor(F.when(total > 0, F.col("votes") * total / votes).otherwise(0.0) + 0.5)
    sure = F.least("bound", F.greatest(F.lit(0), at(F.col(seats) - n / 2) - 1))
    reach = F.least("bound", F.greatest(F.ceil("votes"), at(F.col(seats) + 2 * n)) + 1)
    ranged = parties.withColumn("_sure", F.when(votes > 0, sure).otherwise(0)).withColumn("_reach", F.when(votes > 0, reach).otherwise(0)).withColumn("_given", F.sum("_sure").over(one))
    keys = [*group, *order]
    claims = ranged.filter("_reach > _sure").select(*keys, "votes", seats, "_given", F.explode(F.sequence("_sure", F.col("_reach") - 1)).alias("_k"))
    turn = F.row_number().over(one.orderBy((F.col("votes") / (2 * F.col("_k") + 1)).desc(), *order))
    won = claims.withColumn("_turn", turn).filter(F.col("_turn") <= F.col(seats) - F.col("_given")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    return ranged.join(won, keys, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sure", "_reach", "_given", "_won")


def seeded(seed: str, *parts: Column) -> Column:
    """A hash of 60 bits, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 16, shard_docs: int = 4096, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, source, shard, size, source_size, target (of its source), taken (words, repeats counted).

    Sources in order of code points, null last, have ``weights``, repeating.  Size: words, runs of characters that are no ASCII
    white space; a null or empty text has 0 and nothing is taken of it.  A null doc_id stays null; repeated rows are each
    a document, and rows alike in id, source and text take their places in any order, so that together
    they give the same.  Other columns are ignored.  An empty table gives no rows; where all sizes are 0, so are the targets.
    """
    source, text = F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("_text"))
    place = seeded(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_text"))
    sizes = stored(plain.withColumns({"place": place, "_null": F.col("source").isNull(), "_key": F.coalesce("source", F.lit(""))}).drop("_text"), "sizes")
    key = ["_null", "_key"]
    dealt = sizes.withColumn("shard", F.pmod("place", F.lit(max(1, -(-sizes.count() // shard_docs)))))
    order = Window.partitionBy(*key, "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(dealt.groupBy(*key, "shard").agg(F.sum("size").alias("words")), "shards").withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.floor((2 * F.col("words") + block) / (2 * block)))).otherwise(0))

    totals = parts.groupBy(*key).agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*key)))
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    shares = capped_shares(ranked.withColumn("weight", cycle), most).withColumn("votes", F.when(F.col("words") > 0, F.col("target") * F.col("blocks") / F.col("words")).otherwise(0.0))
    shares = shares.withColumn("bound", most * F.col("blocks")).withColumn("seats", F.floor(F.sum("votes").over(Window.partitionBy(F.lit(0))) + 0.5))
    sources = apportioned(shares, [], ["rank"], "seats").select(*key, "rank", "target", "quota", F.col("words").alias("source_size"), F.col("blocks").alias("source_blocks"))

    divided = parts.join(sources, key).withColumnRenamed("quota", "seats").withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    quotas = apportioned(divided.withColumn("bound", most * F.col("blocks")), ["rank"], ["shard"], "seats")
    first = F.when(F.col("blocks") > 0, F.pmod(seeded(seed, F.col("rank").cast("string"), F.col("shard").cast("string")), F.col("blocks"))).otherwise(0)
    rounds = F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(0)
    quotas = quotas.withColumns({"first": first, "rounds": rounds}).withColumn("more", F.col("quota") - F.col("rounds") * F.col("blocks"))
    edge = lambda i: F.when(F.col("blocks") > 0, F.expr(f"words * ({i}) div blocks")).otherwise(0)  # noqa: E731  (where the i-th block begins)
    quotas = quotas.select(*key, "shard", "target", "source_size", "rounds", edge("first").alias("_a"), edge("least(blocks, first + more)").alias("_b"), edge("greatest(0, first + more - blocks)").alias("_c"))

    placed = dealt.withColumn("_x", F.coalesce(F.sum("size").over(order), F.lit(0))).join(quotas, [*key, "shard"]).withColumn("_y", F.col("_x") + F.col("size"))
    once = F.greatest(F.lit(0), F.least("_y", "_b") - F.greatest("_x", "_a")) + F.greatest(F.lit(0), F.least("_y", "_c") - F.col("_x"))
    return placed.select("doc_id", "source", "shard", "size", "source_size", "target", (F.col("rounds") * F.col("size") + once).alias("taken"))


def oracle_sql(weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 16, shard_docs: int = 4096, seed: str = "mix") -> str:
    """DuckDB SQL for doc_id, size, source_size, target, taken: targets by resharing round by round, seats by ranking every quotient."""
    number = lambda text: f"('0x' || substr(md5({text}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE sized AS MATERIALIZED (SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
    {number(f"'{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))")} AS place FROM documents),
dealt AS MATERIALIZED (SELECT *, place % greatest(1, (((SELECT count(*) FROM sized) + {shard_docs - 1}) // {shard_docs})::BIGINT) AS shard FROM sized),
parts AS MATERIALIZED (SELECT source, shard, words, CASE WHEN words > 0 THEN greatest(1, (2 * words + {block}) // {2 * block}) ELSE 0 END::BIGINT AS blocks
    FROM (SELECT source, shard, sum(size)::BIGINT AS words FROM dealt GROUP BY ALL)),
ranked AS MATERIALIZED (SELECT source, sum(words)::BIGINT AS words, sum(blocks)::BIGINT AS blocks, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM parts GROUP BY source),
weighed AS MATERIALIZED (SELECT *, {list(weights)}[(rank - 1) % {len(weights)} + 1] AS weight FROM ranked),
fill AS (SELECT 0 AS turn, rank, words, weight, false AS held FROM weighed
    UNION ALL SELECT turn + 1, rank, words, weight, held OR {most} * words <= weight * sum(CASE WHEN held THEN words - {most} * words ELSE words END) OVER () / nullif(sum(CASE WHEN held THEN 0 ELSE weight END) OVER (), 0)
    FROM fill WHERE turn <= (SELECT count(*) FROM weighed)),
final AS MATERIALIZED (SELECT rank, words, weight, held FROM fill WHERE turn = (SELECT max(turn) FROM fill)),
level AS (SELECT ((SELECT sum(words) FROM final) - coalesce(sum({most} * words) FILTER (held), 0)) / nullif(sum(weight) FILTER (NOT held), 0) AS v FROM final),
targets AS MATERIALIZED (SELECT w.*, (CASE WHEN f.held THEN {most} * w.words ELSE w.weight * (SELECT v FROM level) END)::DOUBLE AS target FROM weighed w JOIN final f USING (rank)),
votes AS MATERIALIZED (SELECT *, CASE WHEN words > 0 THEN target * blocks / words ELSE 0 END AS v FROM targets),
seats AS MATERIALIZED (SELECT rank, count(*) AS quota FROM (SELECT rank, v, k, row_number() OVER (ORDER BY v / (2 * k + 1) DESC, rank) AS turn FROM (SELECT rank, v, unnest(range({most} * blocks)) AS k FROM votes))
    WHERE turn <= (SELECT floor(sum(v) + 0.5) FROM votes) GROUP BY rank),
divided AS MATERIALIZED (SELECT v.rank, p.source, p.shard, p.words, p.blocks, v.target, v.words AS source_size, coalesce(s.quota, 0) AS seats, CASE WHEN v.words > 0 THEN v.target * p.blocks / v.words ELSE 0 END AS v
    FROM parts p JOIN votes v ON v.source IS NOT DISTINCT FROM p.source LEFT JOIN seats s ON s.rank = v.rank),
shared AS MATERIALIZED (SELECT rank, shard, count(*) AS quota FROM (SELECT rank, shard, seats, row_number() OVER (PARTITION BY rank ORDER BY v / (2 * k + 1) DESC, shard) AS turn FROM (SELECT *, unnest(range({most} * blocks)) AS k FROM divided))
    WHERE turn <= seats GROUP BY ALL),
chosen AS MATERIALIZED (SELECT d.source, d.shard, d.words, d.blocks, i AS i, d.target, d.source_size, q.quota // d.blocks + CASE WHEN (i - {number(f"'{seed}|' || d.rank || '|' || d.shard")} % d.blocks + d.blocks) % d.blocks < q.quota % d.blocks THEN 1 ELSE 0 END AS times
    FROM divided d JOIN shared q ON q.rank = d.rank AND q.shard = d.shard, unnest(range(d.blocks)) t(i)),
placed AS MATERIALIZED (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM dealt),
taken AS (SELECT p.doc_id, p.place, sum(c.times * greatest(0, least(p.x + p.size, c.words * (c.i + 1) // c.blocks) - greatest(p.x, c.words * c.i // c.blocks)))::BIGINT AS n
    FROM placed p JOIN chosen c ON c.source IS NOT DISTINCT FROM p.source AND c.shard = p.shard AND c.i BETWEEN p.x * c.blocks // c.words - 1 AND (p.x + p.size) * c.blocks // c.words + 1 GROUP BY ALL)
SELECT p.doc_id, p.size, t.words AS source_size, t.target, coalesce(k.n, 0)::BIGINT AS taken
FROM placed p JOIN targets t ON t.source IS NOT DISTINCT FROM p.source LEFT JOIN taken k ON k.doc_id IS NOT DISTINCT FROM p.doc_id AND k.place = p.place
"""
