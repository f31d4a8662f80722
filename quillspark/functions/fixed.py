"""Small dimension tables of the text domain."""

# Dynasties as (key, name, English name, first year, last year).
DYNASTIES = [
    ("pre_qin", "先秦", "Pre-Qin", -770, -221),
    ("qin", "秦", "Qin Dynasty", -221, -206),
    ("western_han", "西汉", "Western Han", -206, 8),
    ("eastern_han", "東漢", "Eastern Han", 25, 220),
    ("three_kingdoms", "三國", "Three Kingdoms", 220, 280),
    ("western_jin", "西晉", "Western Jin", 265, 316),
    ("eastern_jin", "東晉", "Eastern Jin", 317, 420),
    ("sixteen_kingdoms", "十六國", "Sixteen Kingdoms", 304, 439),
    ("southern_dynasties", "南朝", "Southern Dynasties", 420, 589),
    ("northern_dynasties", "北朝", "Northern Dynasties", 386, 581),
    ("sui", "隋", "Sui Dynasty", 581, 618),
    ("tang", "唐", "Tang Dynasty", 618, 907),
    ("five_dynasties", "五代", "Five Dynasties", 907, 960),
    ("northern_song", "北宋", "Northern Song", 960, 1127),
    ("southern_song", "南宋", "Southern Song", 1127, 1279),
    ("liao", "遼", "Liao Dynasty", 916, 1125),
    ("jin_jurchen", "金", "Jin (Jurchen)", 1115, 1234),
    ("yuan", "元", "Yuan Dynasty", 1271, 1368),
    ("ming", "明", "Ming Dynasty", 1368, 1644),
    ("qing", "清", "Qing Dynasty", 1644, 1912),
    ("modern", "近現代", "Modern", 1912, 2000),
    ("india", "印度", "India", -500, 1200),
    ("japan", "日本", "Japan", 600, 1900),
    ("korea", "高麗/朝鮮", "Korea", 918, 1910),
    ("tibet", "西藏", "Tibet", 600, 1900),
]
# Other names of dynasties.
DYNASTY_ALIASES = {
    "後漢": "東漢", "劉宋": "南朝", "蕭齊": "南朝", "蕭梁": "南朝", "曹魏": "三國", "吳": "三國", "東吳": "三國",
    "北涼": "十六國", "後秦": "十六國", "姚秦": "十六國", "前秦": "十六國", "西秦": "十六國", "北魏": "北朝", "東魏": "北朝",
    "西魏": "北朝", "北齊": "北朝", "北周": "北朝", "宋": "北宋", "南齊": "南朝", "梁": "南朝", "陳": "南朝",
}
# Collection prefixes of work ids.
COLLECTIONS = {
    "T": "大正藏", "X": "卍新纂續藏經", "A": "趙城金藏", "K": "高麗大藏經", "S": "宋藏遺珍", "F": "房山石經", "C": "中華大藏經",
    "D": "國圖善本", "U": "大藏經補編", "P": "永樂北藏", "J": "嘉興藏", "L": "乾隆大藏經", "G": "佛教大藏經", "M": "卍正藏經",
    "N": "南傳大藏經", "ZS": "正史佛教資料類編", "I": "北朝佛教石刻拓片百品", "ZW": "藏外佛教文獻", "B": "大藏經補編",
    "GA": "中國佛寺志", "GB": "中國佛寺志", "Y": "印順法師佛學著作集", "LC": "呂澂佛學著作集", "W": "藏外佛教文獻",
}
# Dynasties that open a byline.
BYLINE_DYNASTIES = {
    "後漢": "東漢", "吳": "三國", "曹魏": "三國", "西晉": "西晉", "東晉": "東晉", "前秦": "十六國", "後秦": "十六國", "北涼": "十六國",
    "劉宋": "南朝", "蕭齊": "南朝", "梁": "南朝", "陳": "南朝", "北魏": "北朝", "北齊": "北朝", "北周": "北朝", "隋": "隋", "唐": "唐",
    "五代": "五代", "宋": "宋", "遼": "遼", "金": "金", "元": "元", "明": "明", "清": "清", "民國": "民國", "後魏": "北朝", "日本": "日本",
}
# Abbreviations of titles.
TITLE_ABBREVIATIONS = {
    "金刚经": "金剛般若波羅蜜經", "金剛經": "金剛般若波羅蜜經", "心经": "般若波羅蜜多心經", "心經": "般若波羅蜜多心經",
    "法华经": "妙法蓮華經", "法華經": "妙法蓮華經", "华严经": "大方廣佛華嚴經", "華嚴經": "大方廣佛華嚴經",
    "楞严经": "大佛頂如來密因修證了義諸菩薩萬行首楞嚴經", "楞嚴經": "大佛頂如來密因修證了義諸菩薩萬行首楞嚴經",
    "圆觉经": "大方廣圓覺修多羅了義經", "圓覺經": "大方廣圓覺修多羅了義經", "楞伽经": "入楞伽經", "楞伽經": "入楞伽經",
    "维摩经": "維摩詰所說經", "維摩經": "維摩詰所說經", "地藏经": "地藏菩薩本願經", "地藏經": "地藏菩薩本願經",
    "药师经": "藥師琉璃光如來本願功德經", "藥師經": "藥師琉璃光如來本願功德經", "阿弥陀经": "佛說阿彌陀經", "阿彌陀經": "佛說阿彌陀經",
    "无量寿经": "佛說無量壽經", "無量壽經": "佛說無量壽經", "涅盘经": "大般涅槃經", "涅槃經": "大般涅槃經",
    "般若经": "大般若波羅蜜多經", "般若經": "大般若波羅蜜多經", "长阿含经": "長阿含經", "长阿含經": "長阿含經",
    "中阿含经": "中阿含經", "杂阿含经": "雜阿含經", "增一阿含经": "增壹阿含經", "坛经": "六祖大師法寶壇經", "壇經": "六祖大師法寶壇經",
}
# Simplified characters and their traditional forms, place by place.
SIMPLIFIED = "经严华圆觉维阿弥陀无量寿药师杂长坛宝论记传译龙门东汉晋国齐陈罗众灭义观释净禅"
TRADITIONAL = "經嚴華圓覺維阿彌陀無量壽藥師雜長壇寶論記傳譯龍門東漢晉國齊陳羅眾滅義觀釋淨禪"

# Dynasties that stand before a translator's name.
TRANSLATOR_DYNASTIES = ["魏", "隋", "唐", "宋", "元", "明", "清", "南朝", "北朝", "十六國", "東晉", "西晉", "後秦", "後漢", "姚秦", "劉宋", "蕭齊", "梁", "陳", "北魏", "北齊", "北周", "東魏", "西魏", "南齊", "蜀", "吳"]
