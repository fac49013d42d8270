from pyspark.sql import functions as F

from ravelin.operators import grid


def test_bracket_reads_both_sides_in_linear_frames(spark):
    points = spark.createDataFrame([("a", i, float(i)) for i in range(0, 400, 7)] + [("b", 1, 5.0)], "page string, id int, x double")
    lines = spark.createDataFrame([("a", "1", 30.0), ("a", "2", 35.0), ("a", "3", 35.0), ("a", "4", 250.0)], "page string, label string, pos double")
    out = grid.bracket(points, lines, ["page"], "x", "pos", ["label"], 100.0)
    marks = [(30.0, "1"), (35.0, "2"), (35.0, "3"), (250.0, "4")]
    for r in out.collect():
        known = marks if r.page == "a" else []
        before, after = max((m for m in known if m[0] <= r.x), default=None), min((m for m in known if m[0] > r.x), default=None)
        assert (r.before and tuple(r.before), r.after and tuple(r.after)) == (before, after)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_smallest_box_of_many(spark):
    """Copies of a box and boxes around a whole cell are not listed for every point."""
    boxes = [("a", b, float(b * 37 % 90), float(b * 53 % 70), float(b * 37 % 90 + 8 + b % 5 * 9), float(b * 53 % 70 + 7 + b % 3 * 11)) for b in range(300)]
    boxes += [("a", 1000 + b, 0.0, 0.0, 60.0, 60.0) for b in range(500)]
    points = [("a", i, float(i * 7 % 120), float(i * 11 % 100)) for i in range(400)]
    box_rows = spark.createDataFrame(boxes, "page string, box long, x0 double, y0 double, x1 double, y1 double")
    out = grid.containing_box(spark.createDataFrame(points, "page string, id long, x double, y double"), box_rows, 10.0)
    want = {}
    for _, i, x, y in points:
        held = [((x1 - x0) * (y1 - y0), b) for _, b, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1]
        if held:
            want[i] = min(held)
    assert {r.id: (r.area, r.box) for r in out.collect()} == want
    # 500 copies are one row in each of the 49 cells they touch, and a larger box is left out of the 36 they cover
    copies = box_rows.where("box >= 1000")
    larger = copies.limit(1).withColumns({"box": F.lit(2000).cast("long"), "x0": F.lit(-1.0)})
    assert grid.boxes_by_cell(copies, 10.0).count() == 49 and grid.boxes_by_cell(copies.unionByName(larger), 10.0).count() == 49 + 56 - 36


def test_crossings_equal_all_cells(spark):
    verticals = spark.createDataFrame([(p, str(k), k * 13.0 + len(p)) for p in ("a", "bb") for k in range(12)], "page string, label string, pos double")
    horizontals = spark.createDataFrame([(p, chr(65 + k), k * 11.0) for p in ("a", "bb") for k in range(9)], "page string, label string, pos double")
    rows = spark.createDataFrame([("a" if i % 3 else "bb", i, "H" if i % 2 else "V", i * 7.0 % 170 - 9, i * 5.0 % 110 - 9) for i in range(200)], "page string, id int, axis string, x double, y double")
    v, h = (df.withColumnsRenamed({"label": n, "pos": at}) for df, n, at in ((verticals, "v", "tx"), (horizontals, "h", "ty")))
    cells = v.join(h, "page").select("page", F.concat_ws("-", "h", "v").alias("label"), "tx", "ty", F.lit(12.0).alias("scale"))
    want = grid.assign_cell(rows.withColumn("scale", F.lit(12.0)), cells)
    out = grid.assign_crossing(rows, verticals, horizontals, 12.0)
    assert sorted(out.select(*want.columns).collect()) == sorted(want.collect()) and out.count() > 100
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_c") and "Cartesian" not in plan
