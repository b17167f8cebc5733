"""Opening hours stated by hand: lists of days and times, months, holidays, the sun, and what falls back to daylight."""

from pyspark.sql import functions as F

from wayfare.functions.text import open_at

#: Hours, minute, weekday (0: Monday), month, holiday, and whether it is open; the sun is up from 06:00 to 18:00.
CASES = (
    ("24/7", 180, 2, 1, False, True), ("Mo-Su 08:00-20:00", 720, 3, 1, False, True), ("Mo-Su 08:00-20:00", 1320, 3, 6, False, False),
    ("Mo,We 09:00-10:00", 560, 2, 5, False, True), ("Mo,We 09:00-10:00", 560, 1, 5, False, False), ("Mo,We-Fr,Su 09:00-10:00", 560, 6, 5, False, True), ("Mo, We 09:00-10:00", 1320, 2, 5, False, False),
    ("08:00-12:00,13:00-17:00", 750, 0, 5, False, False), ("08:00-12:00,13:00-17:00", 800, 0, 5, False, True), ("08:00-12:00, 13:00-17:00", 700, 0, 5, False, True), ("Mo-Fr 08:00-12:00,13:00-17:00", 800, 5, 5, False, False),
    ("Mar-Oct 09:00-18:00", 1000, 2, 3, False, True), ("Mar-Oct 09:00-18:00", 1000, 2, 11, False, False), ("Mar-Oct 09:00-18:00", 1320, 2, 5, False, False), ("Nov-Feb 09:00-16:00", 600, 2, 1, False, True), ("Nov-Feb 09:00-16:00", 600, 2, 6, False, False),
    ("Jan,Dec 09:00-16:00", 600, 2, 12, False, True), ("Apr-Sep: Mo-Fr 08:00-20:00", 1100, 4, 7, False, True), ("Apr-Sep Mo-Fr 08:00-20:00; Oct-Mar Mo-Fr 08:00-16:00", 1100, 4, 12, False, False),
    ("PH 10:00-12:00", 660, 1, 5, True, True), ("PH 10:00-12:00", 660, 1, 5, False, False), ("Su,PH 10:00-12:00", 660, 6, 5, False, True), ("Mo-Fr 08:00-18:00; PH off", 1320, 1, 5, True, False), ("Mo-Fr 08:00-18:00; PH off", 600, 1, 5, False, True),
    ("sunrise-sunset", 400, 1, 5, False, True), ("sunrise-sunset", 1100, 1, 5, False, False), ("dawn-22:00", 1200, 1, 5, False, True), ("08:00-dusk", 1090, 1, 5, False, False),
    ("(sunrise+01:00)-sunset", 400, 1, 5, False, False), ("(sunrise+01:00)-(sunset-00:30)", 1040, 1, 5, False, True), ("(sunrise+01:00)-(sunset-00:30)", 1060, 1, 5, False, False),
    ("Fr 22:00-02:00", 60, 5, 5, False, True), ("Fr 22:00-02:00", 60, 4, 5, False, False), ("Fr 22:00-02:00", 1380, 4, 5, False, True), ("Fr 22:00-26:00", 100, 5, 5, False, True), ("Fr 22:00-26:00", 130, 5, 5, False, False), ("Su 20:00-04:00", 200, 0, 5, False, True),
    ("Mo-Fr", 100, 2, 5, False, True), ("Mo-Fr", 100, 6, 5, False, False), ("off", 720, 2, 5, False, False), ("Sa-Mo 09:00-17:00", 600, 6, 5, False, True), ("Sa-Mo 09:00-17:00", 600, 3, 5, False, False),
    ("not valid hours at all!!!", 720, 2, 5, False, True), ("not valid hours at all!!!", 1320, 2, 5, False, False), ("", 1320, 2, 5, False, False), (None, 720, 2, 5, False, True), (" ; ", 720, 2, 5, False, True),
    ("24/7;Mo-Su 08:00-20:00", 1320, 2, 5, False, True), ("We[1] 10:00-12:00", 660, 2, 5, False, True), ("08:00-24:00", 1439, 2, 5, False, True), ("00:00-24:00", 0, 2, 5, False, True), ("Mo 25:00-26:00x", 60, 2, 5, False, False),
)


def test_cases(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "id int, hours string, minute int, day int, month int, holiday boolean, want boolean")
    dark = (F.col("minute") < 360) | (F.col("minute") >= 1080)
    got = rows.withColumn("open", open_at(F.col("hours"), F.col("minute"), F.col("day"), dark, F.col("month"), F.col("holiday"), F.lit(360), F.lit(1080)))
    assert [tuple(x) for x in got.filter("NOT open <=> want").collect()] == []


def test_what_is_not_given_falls_back_to_daylight(spark):
    rows = spark.createDataFrame([("Mar-Oct 09:00-18:00", 100), ("Mar-Oct 09:00-18:00", 1000), ("08:00-sunset", 400), ("Mo-Fr 08:00-09:00", 500)], "hours string, minute int")
    dark = (F.col("minute") < 360) | (F.col("minute") >= 1080)
    assert [x[0] for x in rows.select(open_at(F.col("hours"), F.col("minute"), F.lit(2), dark)).collect()] == [False, True, True, True]
