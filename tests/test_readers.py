"""Archives, dictionaries and databases written here, read back in planned partitions."""

import sqlite3
import struct
import zipfile
import zlib

import pytest

from quillspark.sources import readers


def test_zip_members(spark, tmp_path):
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(10):
                z.writestr(f"dir{i % 2}/t{i}.txt", ("經文" * 100 + str(i)).encode("gb18030" if i == 3 else "utf-8"))
            z.writestr("notes.bin", b"\0" * 50)
            z.mkdir("empty")
    readers.register(spark)
    rows = spark.read.format("zip_members").option("path", str(tmp_path)).option("bytes", 1500).load()
    assert rows.count() == 22 and rows.rdd.getNumPartitions() > 8
    some = rows.filter("member = 'dir1/t3.txt'")
    assert some.rdd.getNumPartitions() == 2 and [r.size for r in some.collect()] == [401, 401]  # decided from the directories
    assert rows.filter("startswith(member, 'dir0/')").count() == 10 and rows.filter("member IN ('notes.bin', 'dir0/t0.txt')").count() == 4
    texts = readers.zipped_texts(spark, f"file://{tmp_path}/1.zip", "dir*.txt").orderBy("member").collect()
    assert [r.text for r in texts] == ["經文" * 100 + str(i) for i in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]
    assert readers.zipped_texts(spark, str(tmp_path), "*.none").count() == 0


def packed(data, deflate=True):
    check = struct.pack(">I", zlib.adler32(data))
    return (b"\x02\0\0\0" + check + zlib.compress(data)) if deflate else (b"\0\0\0\0" + check + data)


def write_mdict(path, entries, encoding, version, per_block=3, record_bytes=37):
    """A small .mdx file by the published layout."""
    new, mark = version >= 2, 2 if encoding == "UTF-16" else 1
    codec = "utf-16-le" if mark == 2 else encoding
    number = lambda x: struct.pack(">Q" if new else ">I", x)
    records = [(d + "\0").encode(codec) for _, d in entries]
    offsets = [sum(map(len, records[:i])) for i in range(len(records))]
    blocks, info = [], b""
    for i in range(0, len(entries), per_block):
        keys = [k for k, _ in entries[i : i + per_block]]
        data = b"".join(number(offsets[i + j]) + k.encode(codec) + b"\0" * mark for j, k in enumerate(keys))
        block = packed(data, deflate=i % 2 == 0)
        info += number(len(keys))
        for k in (keys[0], keys[-1]):
            coded = k.encode(codec)
            info += struct.pack(">H" if new else ">B", len(coded) // mark) + coded + (b"\0" * mark if new else b"")
        info += number(len(block)) + number(len(data))
        blocks.append(block)
    head = f'<Dictionary GeneratedByEngineVersion="{version}" Encrypted="No" Encoding="{encoding}" Title="t"/>\r\n\0'.encode("utf-16-le")
    out = struct.pack(">I", len(head)) + head + struct.pack("<I", zlib.adler32(head))
    index = packed(info) if new else info
    sizes = number(len(blocks)) + number(len(entries)) + (number(len(info)) if new else b"") + number(len(index)) + number(sum(map(len, blocks)))
    out += sizes + (struct.pack(">I", zlib.adler32(sizes)) if new else b"") + index + b"".join(blocks)
    flat = b"".join(records)
    parts = [flat[i : i + record_bytes] for i in range(0, len(flat), record_bytes)]
    stored = [packed(p, deflate=i % 2 == 0) for i, p in enumerate(parts)]
    out += number(len(parts)) + number(len(entries)) + number(16 * len(parts)) + number(sum(map(len, stored)))
    out += b"".join(number(len(s)) + number(len(p)) for s, p in zip(stored, parts, strict=True)) + b"".join(stored)
    path.write_bytes(out)


@pytest.mark.parametrize(("encoding", "version"), [("UTF-8", 2.0), ("UTF-16", 2.0), ("UTF-8", 1.2)])
def test_mdict(spark, tmp_path, encoding, version):
    entries = [(f"詞{i:02}", f"<b>meaning</b> {i} " + "long " * (i % 5)) for i in range(20)] + [("alias", "@@@LINK=詞01")]
    write_mdict(tmp_path / "d.mdx", entries, encoding, version)
    readers.register(spark)
    raw = spark.read.format("mdict").option("path", str(tmp_path)).option("blocks", 2).load()
    assert raw.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, raw.collect())) == sorted(entries)
    found = readers.mdict(spark, str(tmp_path / "d.mdx"), blocks=3).orderBy("headword").collect()
    assert [(r.headword, r.definition) for r in found] == [(k, d.replace("<b>", "").replace("</b>", "").strip()) for k, d in entries[:-1]]


def test_mdict_refuses_what_it_cannot_read(tmp_path):
    write_mdict(tmp_path / "d.mdx", [("a", "b")], "UTF-8", 2.0)
    data = (tmp_path / "d.mdx").read_bytes().replace("No".encode("utf-16-le"), "2 ".encode("utf-16-le"))
    (tmp_path / "e.mdx").write_bytes(data)
    with (tmp_path / "e.mdx").open("rb") as f, pytest.raises(ValueError, match="encrypted"):
        readers.Mdict(f)
    with pytest.raises(ValueError, match="LZO"):
        readers.unpacked(b"\x01\0\0\0....")


def test_sqlite(spark, tmp_path):
    path = tmp_path / "d.db"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "pali words" (lemma TEXT, meaning TEXT, pos TEXT, n INTEGER)')
        db.executemany('INSERT INTO "pali words" VALUES (?, ?, ?, ?)', [(f"w{i}", f"means {i}" if i % 7 else None, "noun" if i % 2 else "verb", i) for i in range(200)])
        db.execute('DELETE FROM "pali words" WHERE n BETWEEN 50 AND 120')
        db.execute("CREATE TABLE none (lemma TEXT, meaning TEXT)")
    readers.register(spark)
    rows = spark.read.format("sqlite").schema("lemma string, pos string, n long").option("path", str(path)).option("table", "pali words").option("partitions", 5).load()
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 129
    pushed = rows.filter("pos = 'noun' AND n >= 40 AND length(lemma) = 4")
    assert {r.n for r in pushed.collect()} == {n for n in range(121, 200) if n % 2}
    found = readers.sqlite_entries(spark, str(path), "pali words", "lemma", "meaning", external_id="n")
    assert found.count() == sum(1 for i in range(200) if i % 7 and not 50 <= i <= 120) and found.columns == ["headword", "reading", "definition", "external_id", "entry_data"]
    assert readers.sqlite_entries(spark, f"file://{path}", "none", "lemma", "meaning").count() == 0
