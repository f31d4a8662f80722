"""Dictionary files to entries: headword, reading, definition, external_id, entry_data (JSON)."""

from __future__ import annotations

import codecs
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["headword", "reading", "definition", "external_id", "entry_data"]
# Names under which JSON dictionaries keep each field, best first.
KEYS = {
    "headword": ["headword", "word", "term", "entry", "key", "lemma"],
    "definition": ["definition", "meaning", "gloss", "translation", "english", "value"],
    "reading": ["reading", "pronunciation", "pinyin", "phonetic", "kana"],
    "external_id": ["external_id", "id", "entry_id"],
}
# Encodings tried in turn.
ENCODINGS = ["utf-8", "gb18030", "big5", "euc-jp", "euc-kr"]


def plain(definition: Column) -> Column:
    return F.trim(F.regexp_replace(definition, r"<[^>]+>", ""))


def _entries(rows: DataFrame, headword: Column, reading: Column, definition: Column, external_id: Column, data: Column) -> DataFrame:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = rows.select(blank(headword).alias("headword"), blank(reading).alias("reading"), blank(plain(definition)).alias("definition"), blank(external_id).alias("external_id"), data.alias("entry_data"))
    return out.filter("headword IS NOT NULL AND definition IS NOT NULL")


def delimited(spark: SparkSession, path: str, delimiter: str = "\t", headword: int = 0, definition: int = 1, reading: int | None = None, extra: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Entries of a TSV or CSV file; lines that start with # are skipped, other columns go to entry_data on request."""
    width = max(x for x in (headword, definition, reading or 0)) + 1 + 16 * extra
    names = [f"col_{i}" for i in range(width)]
    reader = spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", delimiter).option("comment", "#").option("encoding", encoding).option("mode", "PERMISSIVE")
    rows = reader.csv(path)
    used = {headword, definition, reading}
    rest = [F.nullif(F.trim(F.col(n)), F.lit("")).alias(n) for i, n in enumerate(names) if i not in used]
    data = F.nullif(F.to_json(F.struct(*rest)), F.lit("{}")) if extra and rest else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    return _entries(rows, F.col(names[headword]), F.col(names[reading]) if reading is not None else none, F.col(names[definition]), none, data)


def json_objects(rows: DataFrame, json: str) -> DataFrame:
    """Entries of JSON texts: arrays of objects under any of the known names, or one object of headword to definition."""
    none = F.lit(None).cast("string")
    items = rows.filter(F.trim(json).startswith("[")).select(F.explode(F.from_json(json, "array<map<string,string>>")).alias("m"))
    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.col("m")[n]), F.lit("")) for n in names])
    known = [n for names in KEYS.values() for n in names]
    extra = F.map_filter("m", lambda k, v: ~k.isin(known) & v.isNotNull() & (v != ""))
    data = F.when(F.size(extra) > 0, F.to_json(extra))
    first = _entries(items, pick(KEYS["headword"]), pick(KEYS["reading"]), pick(KEYS["definition"]), pick(KEYS["external_id"]), data)
    pairs = rows.filter(F.trim(json).startswith("{")).select(F.explode(F.from_json(json, "map<string,string>")))
    return first.unionByName(_entries(pairs, F.col("key"), none, F.col("value"), none, none))


def decoded(content: Column, declared: str | None = None) -> Column:
    """Bytes as text: by byte-order mark, the declared encoding, then those of the list, at last with losses."""

    def one(b) -> str | None:
        if b is None:
            return None
        for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
            if b.startswith(mark):
                return b.decode(name, "replace")
        for name in [declared, *ENCODINGS] if declared else ENCODINGS:
            try:
                return b.decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
        return b.decode("utf-8", "replace")

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(one)

    return text(content)


def stardict(files: DataFrame, index: str, content: str) -> DataFrame:
    """Entries of a StarDict pair: an index of NUL-ended words with offset and size, and the bytes they point to."""

    def read(batches):
        for pdf in batches:
            out = []
            for idx, data in zip(pdf[index], pdf[content], strict=True):
                at = 0
                while (end := idx.find(b"\0", at)) >= 0 and end + 9 <= len(idx):
                    start, size = int.from_bytes(idx[end + 1 : end + 5], "big"), int.from_bytes(idx[end + 5 : end + 9], "big")
                    out.append((idx[at:end].decode("utf-8", "replace"), data[start : start + size].decode("utf-8", "replace")))
                    at = end + 9
            yield pd.DataFrame(out, columns=["word", "meaning"])

    none = F.lit(None).cast("string")
    rows = files.select(index, content).mapInPandas(read, "word string, meaning string")
    return _entries(rows, F.col("word"), none, F.col("meaning"), none, none)


def xml_entries(spark: SparkSession, path: str, row_tag: str, headword: str, definition: str, reading: str | None = None, external_id: str | None = None) -> DataFrame:
    """Entries of an XML dictionary by paths into its entry element."""
    fields = {f for f in (headword, definition, reading, external_id) if f}
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(", ".join(f"`{f}` string" for f in fields)).load(path)
    col = lambda f: F.col(f"`{f}`") if f else F.lit(None).cast("string")
    return _entries(rows, col(headword), col(reading), col(definition), col(external_id), F.lit(None).cast("string"))


def keyed(entries: DataFrame, code: str, order: Sequence[str] = ("headword", "definition")) -> DataFrame:
    """Entries with external ids (code-headword, repeats numbered) and the stores' length limits of 500, 500 and 200."""
    from ..operators.etl import numbered_ids

    base = F.coalesce("external_id", F.concat_ws("-", F.lit(code), "headword"))
    out = numbered_ids(entries.withColumn("_own", base).drop("external_id"), F.col("_own"), list(order)).drop("_own")
    return out.withColumns({"headword": F.substring("headword", 1, 500), "reading": F.substring("reading", 1, 500), "external_id": F.substring("external_id", 1, 200)})
