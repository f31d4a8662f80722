"""Entities and relations taken out of catalog rows."""

import random

import pyarrow as pa

from quillspark.operators import extraction


def test_extraction_at_the_edges(spark):
    texts = spark.createDataFrame([(1, "A", " Kumarajiva ", "Yao Qin"), (2, None, "Kumarajiva", "Yao Qin"), (3, " ", "", None), (None, "Z", None, "Tang"), (1, "B", None, None)], "id int, t string, p string, d string")
    found = extraction.entities(texts, "id", "t", "p", "d", "cat")
    assert sorted((r.kind, r.ref, r.name, r.n_texts, r.ids) for r in found.collect()) == [
        ("dynasty", "Tang", "Tang", 1, {}),
        ("dynasty", "Yao Qin", "Yao Qin", 2, {}),
        ("person", "Kumarajiva", "Kumarajiva", 2, {}),
        ("text", "1", "A", 2, {"cat": "1"}),
        ("text", "2", None, 1, {"cat": "2"}),
        ("text", "3", None, 1, {"cat": "3"}),
    ]
    known = spark.createDataFrame([("text", "1", "mine", {"cat": "old", "x": "9"}), ("text", "2", " ", None), ("text", "7", None, {})], "kind string, ref string, name string, ids map<string,string>")
    out = {(r.kind, r.ref): (r.name, r.ids) for r in extraction.enriched(known, found).collect()}
    assert out["text", "1"] == ("mine", {"cat": "old", "x": "9"}) and out["text", "2"] == (None, {"cat": "2"}) and out["text", "7"] == (None, {})
    assert len(out) == 7
    edges = extraction.role_relations(texts, "id", "p", "d").collect()
    assert sorted(tuple(r) for r in edges) == [("Kumarajiva", "active_in", "Yao Qin", 1.0), ("Kumarajiva", "translated", "1", 1.0), ("Kumarajiva", "translated", "2", 1.0)]
    table = spark.createDataFrame([(5, 1, 2, "alt", 0.95), (4, 1, 2, "alt", None), (6, 1, 2, "alt", 0.0), (1, 2, 1, "alt", 0.4), (2, 2, 1, "other", 1.0), (3, 1, 9, "par", 1.0), (7, 1, 1, "par", 0.0)], "id int, a int, b int, k string, c double")
    of = spark.createDataFrame([(1, "e1"), (2, "e2")], "text int, entity string")
    synced = extraction.synced_relations(table, "id", "a", "b", "k", "c", of, {"alt": ("alt_translation", 0.9, "x"), "par": ("parallel", 0.8, "y")})
    assert sorted(tuple(r) for r in synced.collect()) == [("e1", "alt_translation", "e2", 0.9, "x"), ("e1", "parallel", "e1", 0.8, "y"), ("e2", "alt_translation", "e1", 0.4, "x")]
    empty = extraction.enriched(known.limit(0), found.limit(0))
    assert empty.count() == 0


def test_relations_are_met_in_bounded_runs(spark):
    """Repeated triples, ties of the key, keys that are null and texts of one entity; nothing is sorted where the table is read."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.randint(0, 5), rng.randint(0, 5), rng.choice("abcx"), rng.choice([None, 0.0, 0.2, 0.7])) for _ in range(3000)] + [(1, None, 1, "a", 0.1)]
    table = spark.createDataFrame(rows, "id int, a int, b int, k string, c double").repartition(3)
    of = spark.createDataFrame([(i, f"e{i % 4}") for i in range(5)], "text int, entity string")
    kinds = {"a": ("one", 0.9, "z"), "b": ("one", 0.8, "y"), "c": ("two", 0.5, "x")}
    expected = {}
    for i, a, b, k, c in rows:
        if k in kinds and a in range(5) and b in range(5):
            one = (i is not None, i or 0, c or kinds[k][1], kinds[k][2])
            at = (f"e{a % 4}", kinds[k][0], f"e{b % 4}")
            expected[at] = min(expected.get(at, one), one)
    synced = extraction.synced_relations(table, "id", "a", "b", "k", "c", of, kinds)
    assert sorted(tuple(r) for r in synced.collect()) == sorted((*at, *f[2:]) for at, f in expected.items())
    plan = synced._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "partial_min" not in plan.split("MapInArrow", 1)[1]  # below: toward the table
    batches = pa.Table.from_pylist([{"a": i % 3, "k": (i * 7) % 20 or None, "n": i} for i in range(100)]).to_batches(max_chunksize=10)
    runs = [b.to_pylist() for b in extraction._earliest(["a"], "k", most=50)(iter(batches))]
    got = [r for b in runs for r in b]
    best = lambda part: [r for r in part if (r["k"] or 0) == min(x["k"] or 0 for x in part if x["a"] == r["a"])]
    whole = [r for b in batches for r in b.to_pylist()]
    assert got == best(whole[:50]) + best(whole[50:])


def test_known_texts_are_enriched(spark):
    """Missing names are filled, ids overwritten, the first uid of a text counts, and nothing changes where nothing is new."""
    columns = "text int, name_zh string, name_sa string, name_bo string, name_pi string, name_en string, properties map<string,string>, external_ids map<string,string>"
    known = spark.createDataFrame([(1, "zh", "", None, "p", None, {"cbeta_id": "old", "x": "9"}, None), (2, "zh", "s", "b", "p", "e", {"cbeta_id": "T2"}, {"84000": "toh5", "w": "Q"}), (9, "alone", None, None, None, None, None, None)], columns)
    texts = spark.createDataFrame([(1, "new", "sa", " ", "pi", "en", "T1"), (2, "t", "t", "t", "t", "t", "T2"), (3, "three", None, None, None, "", None)], "id int, title_zh string, title_sa string, title_bo string, title_pi string, title_en string, cbeta_id string")
    uids = spark.createDataFrame([(7, 2, "toh6"), (3, 2, "toh5"), (1, 1, "toh44-45/x"), (2, 3, "none")], "id int, text int, uid string")
    got = {r.text: r for r in extraction.enriched_texts(known, texts, uids, "cbeta_id").collect()}
    assert tuple(got[1])[1:] == ("zh", "sa", None, "p", "en", {"cbeta_id": "T1", "x": "9", "toh_number": "44-45"}, {"84000": "toh44-45/x"}, "updated")
    assert tuple(got[2])[1:] == ("zh", "s", "b", "p", "e", {"cbeta_id": "T2", "toh_number": "5"}, {"84000": "toh5", "w": "Q"}, "updated")
    assert tuple(got[3])[1:] == ("three", None, None, None, None, {}, {"84000": "none"}, "created") and got[9].change is None and got[9].name_zh == "alone"
    again = extraction.enriched_texts(spark.createDataFrame([tuple(r)[:8] for r in got.values()], columns), texts, uids, "cbeta_id").collect()
    assert [r.change for r in again] == [None] * 4
