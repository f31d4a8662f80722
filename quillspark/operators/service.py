"""What the service's pages ask for beyond search: versions, parallels, timelines, layout, facets, runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .ranking import first_per_key, page, running_total
from .storage import stored


def merged_relations(first: DataFrame, second: DataFrame, rename: dict[str, str]) -> DataFrame:
    """(text_id, relation_type, ...) of two lists: the first list wins, kinds of the second are renamed."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in rename.items() for x in p])[F.col("relation_type")], F.col("relation_type"))
    both = first.withColumn("_turn", F.lit(0)).unionByName(second.withColumn("relation_type", kind).withColumn("_turn", F.lit(1)))
    rest = [c for c in first.columns if c not in ("text_id", "relation_type")]
    return first_per_key(both, ["text_id", "relation_type"], ["_turn", *rest]).drop("_turn")


def versions(texts: DataFrame, relations: DataFrame, key: str, title: str, of) -> DataFrame:
    """(id, how): texts related to one, then others of the same title."""
    both = relations.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(relations.select(F.col("b").alias("x"), F.col("a").alias("y")))
    related = both.filter((F.col("x") == F.lit(of)) & (F.col("y") != F.lit(of))).select(F.col("y").alias("id"), F.lit("relation").alias("how")).distinct()
    own = texts.filter(F.col(key) == F.lit(of)).select(F.col(title).alias("_t"))
    same = texts.join(own, F.col(title) == F.col("_t")).filter(F.col(key) != F.lit(of)).select(F.col(key).alias("id"), F.lit("title").alias("how"))
    return related.unionByName(same.join(related.select("id"), "id", "left_anti"))


def parallel_reading(contents: DataFrame, text: str, juan: str, lang: str, a, b, number: int, own: str) -> DataFrame:
    """One row: both texts' chapter, each in the language asked for if there is one, else the first."""
    side = lambda t, n: first_per_key(contents.filter((F.col(text) == F.lit(t)) & (F.col(juan) == number)), [text], [(F.col(lang) == own).desc(), lang]).select(F.col("content").alias(n))
    return side(a, "left").join(side(b, "right"), how="full", on=F.lit(True))


def chapters_in(contents: DataFrame, juan: str, lang: str, own: str) -> DataFrame:
    """(juan, lang): each chapter once, in the language asked for if it has it."""
    return first_per_key(contents, [juan], [(F.col(lang) == own).desc(), lang]).select(juan, lang)


def timeline(rows: DataFrame, year: Column, bins: int) -> DataFrame:
    """(from_year, n) in bins of so many years; undated rows are left out."""
    at = (F.floor(year / bins) * bins).cast("long")
    return rows.filter(year.isNotNull()).groupBy(at.alias("from_year")).agg(F.count(F.lit(1)).alias("n"))


def timeline_rows(rows: DataFrame, year: str, key: str, height: int) -> DataFrame:
    """Rows dealt over ``height`` lines in order of year; undated ones by a hash of the key."""
    dated = running_total(rows.filter(F.col(year).isNotNull()), [year, key], F.lit(1), "_turn").withColumn("line", F.pmod(F.col("_turn") - 1, F.lit(height)).cast("int")).drop("_turn")
    undated = rows.filter(F.col(year).isNull()).withColumn("line", F.pmod(F.xxhash64(key), F.lit(height)).cast("int"))
    return dated.unionByName(undated)


def dated_timeline(items: DataFrame, key: str, dynasty: str, kinds: dict[str, Sequence[str] | None], number: int, size: int) -> DataFrame:
    """One page of items on the time axis: those of the wanted values of each column (None: all), with the years of
    their dynasty and the number of items over all pages, by first year (undated last) and key."""
    rows = items
    for column, wanted in kinds.items():
        if wanted is not None:
            rows = rows.filter(F.col(column).isin(list(wanted)))
    table = rows.sparkSession.createDataFrame([(n, a, b) for _, n, _, a, b in fixed.DYNASTIES], "_dynasty string, first_year int, last_year int")
    dated = rows.join(F.broadcast(table), F.col(dynasty) == F.col("_dynasty"), "left").drop("_dynasty")  # a fixed table
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    return page(dated, [F.asc_nulls_last("first_year"), key], number, size).join(total)


def line_kind(line: Column) -> Column:
    """What a line of a canon text is: chapter, byline, section, head, verse or prose."""
    bare = F.trim(line)
    return (
        F.when(bare == "", "blank")
        .when(bare.rlike(r"卷(第)?[一二三四五六七八九十百上中下]+$"), "juan")
        .when(bare.rlike(r"(譯|撰|造|述|集|著)$") & (F.length(bare) <= 30), "byline")
        .when(bare.rlike(r"品第[一二三四五六七八九十百]+$"), "section")
        .when(bare.rlike(r"^[\x{4E00}-\x{9FFF}]{4,7}([　 ]+[\x{4E00}-\x{9FFF}]{4,7})+$"), "verse")
        .otherwise("prose")
    )


def merged_prose(lines: DataFrame, doc: str, at: str, line: str) -> DataFrame:
    """(doc, block, kind, text): neighbouring prose lines joined to one block, others a block each."""
    w = Window.partitionBy(doc).orderBy(at)
    rows = lines.withColumn("kind", line_kind(F.col(line)))
    fresh = (F.col("kind") != "prose") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != "prose")
    rows = rows.withColumn("block", F.sum(fresh.cast("int")).over(w)).filter("kind <> 'blank'")
    out = rows.groupBy(doc, "block").agg(F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct(at, line))).alias("l"))
    return out.select(doc, "block", "kind", F.array_join(F.transform("l", lambda x: F.trim(x[line])), "").alias("text"))


def blocks(rows: DataFrame, doc: str, at: str, flag: str, text: str) -> DataFrame:
    """(doc, block, flag, text): neighbours with one flag joined."""
    w = Window.partitionBy(doc).orderBy(at)
    marked = rows.withColumn("block", F.sum((F.coalesce(F.lag(flag).over(w), ~F.col(flag)) != F.col(flag)).cast("int")).over(w))
    out = marked.groupBy(doc, "block", flag).agg(F.sort_array(F.collect_list(F.struct(at, text))).alias("l"))
    return out.select(doc, "block", flag, F.array_join(F.transform("l", lambda x: x[text]), "").alias("text"))


def split_search(rows: DataFrame, fields: Sequence[str], query: str, key: str, most: int = 30) -> DataFrame:
    """Rows whose fields together hold the query, all its words, or both halves of some cut of it."""
    whole = F.lower(F.concat_ws("", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    has = lambda x: F.contains(whole, F.lit(x.lower()))
    hit = has(query)
    words = query.split()
    if len(words) > 1:
        every = has(words[0])
        for w in words[1:]:
            every = every & has(w)
        hit = hit | every
    for i in range(1, len(query)):
        hit = hit | (has(query[:i].strip()) & has(query[i:].strip()))
    return rows.filter(hit).orderBy(key).limit(most)


def research_fields(name: Column, languages: Column, rules: Sequence[tuple[str, str]], by_language: dict[str, str], fallback: str) -> Column:
    """Sorted comma list of fields by language and by keyword pattern of the name; the fallback if none."""
    parts = F.split(F.lower(F.coalesce(languages, F.lit(""))), ",")
    found = [F.when(F.array_contains(parts, F.lit(code)), F.lit(field)) for code, field in by_language.items()]
    found += [F.when(F.coalesce(name, F.lit("")).rlike(pattern), F.lit(field)) for field, pattern in rules]
    fields = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    return F.when(F.size(fields) > 0, F.array_join(fields, ",")).otherwise(F.lit(fallback))


def region(value: Column) -> Column:
    """Usual region names; a missing one is 其他."""
    # Regions written another way.
    other = {"中国": "中国大陆", "台湾": "中国台湾"}
    x = F.nullif(F.trim(value), F.lit(""))
    return F.coalesce(F.create_map(*[F.lit(y) for p in other.items() for y in p])[x], x, F.lit("其他"))


def listed_order(value: Column, order: Sequence[str], unknown: int = 98, last: str | None = None) -> Column:
    """A sort key: the place in a list, ``unknown`` for others, after all for ``last``."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    key = F.when(place > 0, place).otherwise(unknown)
    return F.when(value == last, 999).otherwise(key) if last else key


def federated_search(parts: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The hits of the engines that answer, each with its origin and the number of all, and the errors of those that do not.

    Each answer is written as it comes, so an engine that fails while it is read fails alone.
    """
    found, failed = {}, {}
    for origin, ask in parts.items():
        try:
            found[origin] = stored(ask(), "federated")
        except Exception as error:
            failed[origin] = str(error)[:500]
    if not found:
        return None, failed
    hits = federated(found)
    return hits.join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total")))), failed  # one row


def federated(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of several engines' hits with their origin; columns one of them lacks are null."""
    out = None
    for origin, df in parts.items():
        one = df.withColumn("origin", F.lit(origin))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def embedded(rows: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]], least: int = 10, batch: int = 20) -> DataFrame:
    """Rows with ``embedding`` by a model called on batches in each task; texts under ``least`` characters are left out."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, embedding array<float>"

    def run(frames):
        for pdf in frames:
            vectors = []
            for i in range(0, len(pdf), batch):
                vectors += encode(pdf[text].iloc[i : i + batch].tolist())
            yield pdf.assign(embedding=vectors)

    return rows.filter(F.length(F.trim(text)) >= least).mapInPandas(run, schema)


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for an embedding model: a unit vector from the text's hash, always alike."""

    def encode(texts: list[str]) -> list[list[float]]:
        import hashlib

        import numpy as np

        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(dim)
            out.append([float(x) for x in v / np.linalg.norm(v)])
        return out

    return encode


def source_text(fields: Sequence[tuple[str, Column]]) -> Column:
    """Labelled lines of the known fields."""
    return F.concat_ws("\n", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in fields])


def run_log(spark, source: str, started: str, finished: str, stats: dict[str, int], error: str | None = None) -> DataFrame:
    """One row of an import log."""
    import json

    status = "failed" if error else "success"
    return spark.createDataFrame([(source, status, started, finished, json.dumps(stats, sort_keys=True), error)], "source_code string, status string, started_at string, finished_at string, stats_json string, error_log string")


def run_in_order(steps: Sequence[tuple[int, str, Callable[[], None]]], done: Sequence[str] = ()) -> list[str]:
    """Import steps by priority, then name; those already done are skipped, and a step that fails stops the rest of its priority only."""
    ran, failed = [], set()
    for priority, name, step in sorted(steps, key=lambda s: (s[0], s[1])):
        if name in done or any(p < priority for p in failed):
            continue
        try:
            step()
            ran.append(name)
        except Exception:
            failed.add(priority)
    return ran


def deleted(rows: DataFrame, keys: DataFrame, key: Sequence[str], children: DataFrame | None = None, parent: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows that stay, and of their children those whose parent stays."""
    left = rows.join(keys, list(key), "left_anti")
    if children is None:
        return left, None
    return left, children.join(left.select(F.col(key[0]).alias(parent)), parent, "left_semi")


def views(base: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Counters with a log of views added."""
    fresh = log.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return base.join(fresh, key, "left").withColumn("view_count", F.coalesce("view_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def index_rows(texts: DataFrame, sources: DataFrame, code: str) -> DataFrame:
    """Catalog rows for the index: source code, has_content false and language lzh by default."""
    joined = texts.join(sources, "source_id", "left")
    return joined.withColumns({"source_code": F.coalesce("source_code", F.lit(code)), "has_content": F.coalesce("has_content", F.lit(False)), "lang": F.coalesce("lang", F.lit("lzh"))})


def seo_text(parts: Sequence[Column], size: int = 160) -> Column:
    whole = F.concat_ws(" · ", *parts)
    return F.when(F.length(whole) > size, F.concat(F.substring(whole, 1, size - 1), F.lit("…"))).otherwise(whole)


def canonical_parallels(relations: DataFrame, texts: DataFrame, contents: DataFrame, chunks: DataFrame, text_id, provenance: str, preview: int = 240) -> DataFrame:
    """Other ends of one provenance's relations of a text: related_id, code, title, lang, relation_type, note, own_preview, english_preview, total.

    The title is the first there is of title_pi, title_sa, title_en and title_zh, else empty.  Only Pali texts
    have previews: the start of their first Pali chapter and of their first chunk.  Parallels come first, then by code.
    """
    mine = relations.filter((F.col("source") == provenance) & ((F.col("a") == text_id) | (F.col("b") == text_id)))
    ends = mine.select(F.when(F.col("a") == text_id, F.col("b")).otherwise(F.col("a")).alias("related_id"), "relation_type", "note")
    titled = texts.select(F.col("id").alias("related_id"), "code", F.coalesce("title_pi", "title_sa", "title_en", "title_zh", F.lit("")).alias("title"), F.coalesce("lang", F.lit("")).alias("lang"))
    own = contents.filter(F.col("lang") == "pi").groupBy(F.col("text_id").alias("related_id")).agg(F.min_by(F.substring("content", 1, preview), "chapter").alias("own_preview"))
    english = chunks.groupBy(F.col("text_id").alias("related_id")).agg(F.min_by(F.substring("chunk_text", 1, preview), F.struct("chapter", "chunk")).alias("english_preview"))
    found = ends.join(titled, "related_id").join(own, "related_id", "left").join(english, "related_id", "left")
    only_pali = lambda c: F.when(F.col("lang") == "pi", F.nullif(F.col(c), F.lit(""))).alias(c)
    rows = found.select("related_id", "code", "title", "lang", "relation_type", "note", only_pali("own_preview"), only_pali("english_preview"))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    return rows.join(total).orderBy(F.when(F.col("relation_type") == "parallel", 0).otherwise(1), "code", "related_id")
