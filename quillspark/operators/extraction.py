"""A graph taken out of catalog rows: entities, relations of roles, relations kept in other tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many rows go to one task of the last grouping, on average.
ROWS = 500_000


def _given(x: Column | str) -> Column:
    return F.nullif(F.trim(F.col(x) if isinstance(x, str) else x), F.lit(""))


def entities(texts: DataFrame, key: str, title: str, person: str, dynasty: str, system: str) -> DataFrame:
    """(kind, ref, name, n_texts, ids) of the persons, dynasties and texts that the rows name; blank names name nothing.

    Persons and dynasties are known by their name, texts by their key, which also goes into ``ids`` under ``system``.
    Of several titles of one key the smallest is taken.
    """
    named = [F.struct(F.lit(kind).alias("kind"), _given(column).alias("ref"), _given(column).alias("name")) for kind, column in (("person", person), ("dynasty", dynasty))]
    own = F.struct(F.lit("text").alias("kind"), F.col(key).cast("string").alias("ref"), _given(title).alias("name"))
    rows = texts.select(F.inline(F.array(*named, own))).filter("ref IS NOT NULL")
    counted = rows.groupBy("kind", "ref").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n_texts"))
    return counted.withColumn("ids", F.when(F.col("kind") == "text", F.create_map(F.lit(system), F.col("ref"))).otherwise(F.expr("cast(map() AS map<string, string>)")))


def enriched(known: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, ref, name, ids): known entities with a missing name filled and new ids added, and the entities not known yet.

    What is known stays: a name that is there, and the id a system already gave.
    """
    none = F.expr("cast(map() AS map<string, string>)")
    new = found.select("kind", "ref", F.col("name").alias("_name"), F.coalesce("ids", none).alias("_ids"))
    both = known.select("kind", "ref", "name", "ids").join(new, ["kind", "ref"], "full_outer")
    old_ids, new_ids = F.coalesce("ids", none), F.coalesce("_ids", none)
    added = F.map_filter(new_ids, lambda k, _: ~F.array_contains(F.map_keys(old_ids), k))
    return both.select("kind", "ref", F.coalesce(_given("name"), F.col("_name")).alias("name"), F.map_concat(old_ids, added).alias("ids"))


def role_relations(texts: DataFrame, key: str, person: str, dynasty: str) -> DataFrame:
    """(subject, predicate, object, confidence): who translated which text, and in which dynasty someone was active; each once, at 1."""
    who = _given(person)
    edge = lambda predicate, to: F.struct(who.alias("subject"), F.lit(predicate).alias("predicate"), to.alias("object"))
    rows = texts.select(F.inline(F.array(edge("translated", F.col(key).cast("string")), edge("active_in", _given(dynasty)))))
    return rows.dropna().distinct().withColumn("confidence", F.lit(1.0))


def enriched_texts(known: DataFrame, texts: DataFrame, identifiers: DataFrame, system: str, source: str = "84000", number: str = "toh_number") -> DataFrame:
    """(text, names, properties, external_ids, change) of the text entities, after the catalog's rows have been taken in.

    ``known`` has text, name_zh, name_sa, name_bo, name_pi, name_en, properties and external_ids (maps of strings); ``texts`` has id, title_zh to
    title_en and ``system`` (the id in that catalog); ``identifiers`` has id, text and uid of ``source``, of which a text's first counts.
    A known entity gets the names it lacks, but for name_zh; its id in the catalog, its number in the uid and its uid are overwritten where they differ.
    Texts not known become entities.  ``change`` is created, updated or null; known entities without a catalog row stay as they are.
    """
    tongues = ["zh", "sa", "bo", "pi", "en"]
    uid = identifiers.groupBy(F.col("text").alias("_text")).agg(F.min_by("uid", "id").alias("_uid"))
    rows = texts.select(F.col("id").alias("_id"), *[_given(f"title_{x}").alias(f"_{x}") for x in tongues], _given(system).alias("_own")).join(uid, F.col("_id") == F.col("_text"), "left")
    rows = rows.withColumn("_uid", _given("_uid")).withColumn("_number", F.nullif(F.regexp_extract("_uid", r"([0-9]+(?:-[0-9]+)?)", 1), F.lit("")))
    both = known.withColumn("_there", F.lit(True)).join(rows, F.col("text") == F.col("_id"), "full_outer")
    none = F.expr("cast(map() AS map<string, string>)")
    there = F.col("_there").isNotNull()

    def given(column: str, pairs: list[tuple[str, Column]]) -> Column:
        new = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))
        old = F.coalesce(column, none)
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)

    names = {f"name_{x}": F.when(there & (F.lit(x == "zh") | _given(f"name_{x}").isNotNull()), F.col(f"name_{x}")).otherwise(F.col(f"_{x}")) for x in tongues}
    out = both.select(F.coalesce("text", "_id").alias("text"), *[c.alias(n) for n, c in names.items()], given("properties", [(system, F.col("_own")), (number, F.col("_number"))]).alias("properties"), given("external_ids", [(source, F.col("_uid"))]).alias("external_ids"),
                      there.alias("_there"), *[F.col(f"name_{x}").alias(f"_old_{x}") for x in tongues], F.coalesce("properties", none).alias("_old_p"), F.coalesce("external_ids", none).alias("_old_e"))
    same = lambda a, b: F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
    kept = same("properties", "_old_p") & same("external_ids", "_old_e")
    for x in tongues:
        kept = kept & F.coalesce(f"name_{x}", F.lit("")).eqNullSafe(F.coalesce(f"_old_{x}", F.lit("")))
    change = F.when(~F.col("_there"), "created").when(~kept, "updated")
    return out.select("text", *names, "properties", "external_ids", change.alias("change"))


def _earliest(keys: Sequence[str], order: str, most: int = 1 << 18) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """Of each run of about ``most`` rows those that are first by ``order`` (null before all) of their keys; all of them, if several are."""

    def told(held: list[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        code = np.zeros(len(whole), np.int64)
        for c in keys:
            coded = whole.column(c).combine_chunks().dictionary_encode("encode")
            code = code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        rank = pc.rank(whole.column(order), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        by = np.lexsort((rank, code))
        new = np.append(True, code[by][1:] != code[by][:-1])
        least = rank[by][np.flatnonzero(new)][np.cumsum(new) - 1]
        keep = np.sort(by[rank[by] == least])
        yield from held if len(keep) == len(whole) else whole.take(pa.array(keep)).to_batches(max_chunksize=1 << 16)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if len(batch) else []
            if sum(map(len, held)) >= most:
                yield from told(held)
                held = []
        if held:
            yield from told(held)

    return kept


def synced_relations(table: DataFrame, key: str, left: str, right: str, kind: str, confidence: str, entity_of: DataFrame, predicates: dict[str, tuple[str, float, str]]) -> DataFrame:
    """(subject, predicate, object, confidence, source) from a relation table between texts.

    ``entity_of`` (text, entity; one row a text) gives both ends; relations of texts without an entity are left out, as are kinds
    that ``predicates`` (kind: predicate, confidence and source) does not rename.  No confidence, or 0, becomes the
    predicate's own.  Of equal triples the first by ``key`` stays, whatever its confidence.
    """
    names, sources = (sorted({p[i] for p in predicates.values()}) for i in (0, 2))  # in the order of the strings
    if not predicates:
        return table.sparkSession.createDataFrame([], "subject string, predicate string, object string, confidence double, source string")
    of = lambda value: F.create_map(*[F.lit(x) for k, p in predicates.items() for x in (k, value(p))])[F.col(kind)]
    sure = F.coalesce(F.nullif(F.col(confidence).cast("double"), F.lit(0.0)), of(lambda p: float(p[1])))
    known = table.filter(F.col(kind).isin(list(predicates)))
    rows = known.select(F.col(key).alias("_k"), F.col(left).alias("_l"), F.col(right).alias("_r"), of(lambda p: names.index(p[0])).alias("_p"), sure.alias("confidence"), of(lambda p: sources.index(p[2])).alias("_s"))
    # An aggregate would sort all rows of a task of the scan, as its buffer is a struct; runs of bounded length meet instead, so a repeated
    # triple is sent once for each run, and what one task groups is set by the number of rows.
    first = lambda df, *by: df.mapInArrow(_earliest(by, "_k"), df.schema)
    ends = lambda at, name: entity_of.select(F.col("text").alias(at), F.col("entity").alias(name))
    joined = first(rows, "_l", "_r", "_p").join(ends("_l", "subject"), "_l").join(ends("_r", "object"), "_r").drop("_l", "_r")
    parts = max(1, -(-table.count() // ROWS))
    met = first(joined, "subject", "object", "_p").repartition(parts, "subject", "object", "_p")
    out = met.groupBy("subject", "object", "_p").agg(F.min(F.struct("_k", "confidence", "_s")).alias("_f"))
    word = lambda values, at: F.element_at(F.array(*map(F.lit, values)), F.col(at) + 1)
    return out.select("subject", word(names, "_p").alias("predicate"), "object", "_f.confidence", word(sources, "_f._s").alias("source"))
