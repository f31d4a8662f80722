"""The reading layout against a loop with state."""

import random
import re

from quillspark.operators import reading


def model(lines):
    verse_on, first, last, out, prose = True, None, "", [], ""

    def end():
        nonlocal prose
        if prose:
            out.append(("prose", prose))
        prose = ""

    def like_verse(x):
        marks = len(re.findall("[，。、；：！？]", x))
        if not 4 <= len(x) <= 22 or x[-1] not in "，。；" or marks > 2:
            return False
        if re.search(r"\s{2,}", x):
            return True
        halves = [len(p) for p in re.split("[，。、；]", x)]
        if marks == 2 and halves[0] and halves[1]:
            return min(halves[:2]) / max(halves[:2]) >= 0.5
        return marks == 1 and len(x) <= 12

    for i, x in enumerate(line.strip() for line in lines):
        if not x:
            if last[-1:] in tuple("。！？」』"):
                end()
                out.append(("break", ""))
            continue
        last, first = x, i if first is None else first
        digits = "[一二三四五六七八九十百千0-9]"
        kind = (
            "juan" if re.search(f"卷第?{digits}", x) and len(x) <= 25 and not re.search("[，。]", x)
            else "byline" if x[-1] in "譯译述撰注疏記造" and len(x) <= 25 and not re.search("[，。；]", x)
            else "section" if re.match("[（(][一二三四五六七八九十0-9]+[）)]", x) or re.search("[品分經]第[一二三四五六七八九十百0-9]", x) and len(x) <= 20 and not re.search("[，。]", x)
            else "head" if i - first <= 2 and 2 <= len(x) <= 15 and re.search("[經论論律品序疏記集傳]", x) and not re.search("[，。；：！？、]", x)
            else None
        )
        if kind:
            end()
            out.append((kind, x))
        elif re.match("論曰|述曰|疏曰|解曰|釋曰", x):
            end()
            prose, verse_on = x, False
        elif re.search("[頌偈]曰", x):
            prose += x
            end()
            verse_on = True
        elif verse_on and like_verse(x):
            end()
            out.append(("verse", x))
        else:
            prose, verse_on = prose + x, verse_on and like_verse(x)
    end()
    return out


PIECES = [
    "佛說長阿含經", "佛說長阿含經卷第一", "後秦佛陀耶舍譯", "（一）第一分", "大緣方便經第二", "諸一切種諸冥滅，拔眾生出生死泥，", "敬禮如是如理師，", "色即是空，空，", "五言五言五，", "甲：乙乙乙，",
    "論曰：諸言所表謂佛世尊", "頌曰：", "如是頌曰：次說", "偈曰", "聖眾，故先讚德，方申敬禮。諸言所表謂佛", "一時佛在舍衛國。", "淨", "色", "", "", "  ", "　諸行無常　　是生滅法。", "經", "短。", "問曰，", "空 空，", "序品第一，", "卷第一，有點", "𠀀𠀁𠀂字字字字字字字，",
]


def test_layout(spark):
    rng = random.Random(11)
    docs = {d: rng.choices(PIECES, k=rng.randint(0, 40)) for d in range(120)}
    docs[500] = ["", "長阿含經序", "長安釋僧肇述", "", "歸命大智海，", "", "論曰：此初說。", "", "餘", "頌曰：", "諸法從緣生，", "一時。尾"]
    rows = [(d, i, x if x or i % 2 else None) for d, lines in docs.items() for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc int, at int, line string").repartition(3)
    got = {}
    for r in reading.layout(df, "doc", "at", "line").collect():
        got.setdefault(r.doc, []).append((r.segment, r.kind, r.text))
    for d, lines in docs.items():
        own = sorted(got.get(d, []))
        if not any("𠀀" in x for x in lines):  # the loop counts characters
            assert [x[1:] for x in own] == model(lines), d
        assert [x[0] for x in own] == list(range(len(own)))
    assert [k for _, k, _ in sorted(got[500])] == ["head", "byline", "verse", "prose", "break", "prose", "verse", "prose"]
