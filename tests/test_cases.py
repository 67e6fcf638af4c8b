"""Expressions against literal cases: nothing of an expression is repeated here."""

from pyspark.sql import functions as F

from lodestore.functions import text as tx
from lodestore.operators import resolve as rs

#: Filenames and whether they keep to the contract.
NAMING_CASES = (
    ("菏泽双龙_工艺设备表_燃烧系统_ZH.xls", True), ("Norda_产品宣传册_EN.pdf", True), ("Cedar Plant_Equipment List_20261015_EN_V2.xlsx", True), ("回转窑_RK-081_总装图_ZH_R1.dwg", True), ("石灰煅烧厂_总平面布置图.pdf", True),
    ("scan001.pdf", False), ("对象_文件.pdf", False), ("未知_设备清单.pdf", False), ("对象__设备清单.pdf", False), ("对象_设备清单_20260230_ZH.pdf", False), ("对象_设备清单_ZH_20261015.pdf", False), ("对象_设备清单_ZH_FR.pdf", False),
    ("../对象_设备清单.pdf", False), ("对象_设备清单_待确认.pdf", False), ("对象_设备清单_中文.pdf", False), ("回转窑_设备清单_20261015_ZH_V2.exe", False), ("回转窑_设备清单_ZH-EN.PDF", True),
)


#: Evidence, summary, readings of the evidence that the summary lacks.
NUMERIC_CASES = (
    ("孔径 φ12；内侧 350", "孔径 R1.2；内侧 330", "350 φ12"), ("外径 Ø675 h8；公差 -0.125；圆角 R2", "外径 φ675 h8；公差 -0.125", "R2"), ("内侧350，允许±0.3", "内侧330，允许0.3", "350 ±0.3"), ("φ12 350 Ø675 h8 -0.125 R2", "φ12 350 Ø675 h8 -0.125 R2", ""),
    ("φ12", "ø１２", ""), ("公差 －0.5 φ１２", "0.5", "-0.5 φ12"), ("角 45 ° 与 4⁵", "45°", "45"), ("½ 1.50 007", "1⁄2 1.5 7", ""), ("1,5 1.2.3", "1.5", "1,5 1.2.3"), ("㎜ 12㎜", "12mm", ""), ("10.0 100", "10 1e2", "100"),
)


#: Texts and their tokens, joined by bars.
SEGMENT_CASES = (("最高工作温度为80摄氏度", "最高|高工|工作|作温|温度|度为|80|摄氏|氏度"), ("AX-210B 型号", "ax|210b|型号|ax-210b"), ("水", "水"), ("plain words only", "plain|words|only"), ("", ""))



def test_naming(spark):
    got = spark.createDataFrame(list(enumerate(n for n, _ in NAMING_CASES)), "nr int, name string").select("nr", rs.compliant(F.col("name")).alias("compliant")).orderBy("nr").collect()
    assert [r["compliant"] for r in got] == [c for _, c in NAMING_CASES]


def test_numeric_gaps(spark):
    cases = spark.createDataFrame([(k, e, s) for k, (e, s, _) in enumerate(NUMERIC_CASES)], "nr int, evidence string, summary string")
    got = tx.with_numeric_gaps(cases, "evidence", "summary").select("nr", F.array_join("gaps", " ").alias("missing"), F.array_join(tx.numeric_gaps(F.col("evidence"), F.col("summary")), " ").alias("one")).orderBy("nr").collect()
    assert [r["missing"] for r in got] == [r["one"] for r in got] == [g for _, _, g in NUMERIC_CASES]


def test_the_keys_of_readings_are_computed_once_a_row(spark):
    cases = spark.createDataFrame([("1 2", "2")], "evidence string, summary string")
    plan = tx.with_numeric_gaps(cases, "evidence", "summary")._jdf.queryExecution().optimizedPlan().toString()
    inside = plan[plan.index("filter(") :]
    assert "transform(" not in inside[: inside.index("gaps")]


def test_segmented(spark):
    cases = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SEGMENT_CASES)], "nr int, text string")
    got = cases.select("nr", F.array_join(tx.segmented(F.col("text")), "|").alias("tokens")).orderBy("nr").collect()
    assert [r["tokens"] for r in got] == [t for _, t in SEGMENT_CASES]
