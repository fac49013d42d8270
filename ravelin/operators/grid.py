"""Positioned texts: clusters on a line, grid lines, nearest intersections, boxes, tables and views.

Positions are matched by equi-joins on cells of a fixed width, never by comparing all points with all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.operators.ordering import lag_in_chunks, running_sum_in_chunks, top_per_key
from ravelin.operators.quantiles import grouped_quantile
from ravelin.session import cut_lineage

CORNER = 0.8


def sheet_code(lines: DataFrame, pages: DataFrame, pattern: str = r"^S-?\d{3}[A-Z]?$") -> DataFrame:
    """Largest matching code in the bottom-right fifth of each page."""
    sized = lines.join(pages, "page")
    corner = (F.col("x") >= F.col("width") * CORNER) & (F.col("y") >= F.col("height") * CORNER)
    best = top_per_key(sized.where(corner & F.col("body").rlike(pattern)), ["page"], [F.desc("size"), F.asc("line")])
    return pages.join(best.select("page", F.col("body").alias("sheet")), "page", "left")


def bracket(points: DataFrame, lines: DataFrame, keys: list[str], at: str, pos: str, values: list[str], width: float) -> DataFrame:
    """Add ``before`` and ``after``: the last line at or before each point and the first line past it, as structs.

    ``lines`` holds ``keys``, ``pos`` and ``values``. Keys are cut into stretches of ``width``; one
    row per key and stretch carries the nearest line from the stretches on either side. Lines ahead are read
    in the reversed order: a frame that runs to the end of the window is read anew for every row.
    """
    stretch = lambda c: F.floor(F.col(c) / width)
    line = F.struct(F.col(pos).alias("pos"), *[F.col(v).alias(v) for v in values])
    marks = lines.select(*keys, F.col(pos).alias("_p"), stretch(pos).alias("_s"), line.alias("_line"))
    rows = points.withColumn("_p", F.col(at).cast("double")).withColumn("_s", stretch(at))
    ends = marks.groupBy(*keys, "_s").agg(F.min("_line").alias("_first"), F.max("_line").alias("_last"))
    spots = rows.select(*keys, "_s").distinct().join(ends, [*keys, "_s"], "full")
    across, earlier = W.partitionBy(*keys), (W.unboundedPreceding, -1)
    carry = spots.select(
        *keys, "_s", F.last("_last", True).over(across.orderBy("_s").rowsBetween(*earlier)).alias("_back"),
        F.last("_first", True).over(across.orderBy(F.desc("_s")).rowsBetween(*earlier)).alias("_ahead"),
    )
    both = rows.withColumn("_line", F.lit(None).cast(marks.schema["_line"].dataType)).withColumn("_kind", F.lit(1)).unionByName(
        marks.withColumn("_p", F.col("_p").cast("double")).withColumn("_kind", F.lit(0)), allowMissingColumns=True
    )
    inside, order = W.partitionBy(*keys, "_s"), ["_p", "_kind", "_line"]
    placed = both.withColumns(
        {
            "_in_back": F.last("_line", True).over(inside.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)),
            "_in_ahead": F.last("_line", True).over(inside.orderBy(*[F.desc(c) for c in order]).rowsBetween(*earlier)),
        }
    ).where("_kind = 1")
    out = placed.join(carry, [*keys, "_s"], "left").withColumns(
        {"before": F.coalesce("_in_back", "_back"), "after": F.coalesce("_in_ahead", "_ahead")}
    )
    return out.select(*points.columns, "before", "after")


def cluster(
    df: DataFrame, keys: list[str], at: str, tie: str, tol: float, width: float, name: str = "cluster", strict: bool = False
) -> DataFrame:
    """Number the groups of positions whose neighbours are at most (``strict``: less than) ``tol`` apart."""
    chunk = F.floor(F.col(at) / width)
    gaps = lag_in_chunks(df, keys, [at, tie], chunk, [at], "_b_")
    gap = F.col(at) - F.col(f"_b_{at}")
    opens = (gap.isNull() | ((gap >= tol) if strict else (gap > tol))).cast("int")
    return running_sum_in_chunks(gaps, keys, [at, tie], chunk, opens, name).drop(f"_b_{at}")


def modal_band(clusters: DataFrame, keys: list[str], at: str, name: str = "cluster") -> DataFrame:
    """Median of the largest cluster of each key (the first one on a tie)."""
    sizes = clusters.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col(name)).alias("_c"))).alias("_m")).select(
        *keys, (-F.col("_m._c")).alias(name), F.col("_m._n").alias("n")
    )
    return grouped_quantile(clusters.join(best, [*keys, name]), keys, {"band": F.col(at)}).join(best.select(*keys, "n"), keys)


def label_value(label: Column) -> Column:
    """Number of a grid label: digits as they are, letters from A = 0, doubled letters from 100."""
    letters = F.regexp_extract(label, r"^([A-Z]+)", 1)
    value = F.ascii(letters) - 65 + F.when(F.length(letters) == 2, 100).otherwise(0)
    part = F.coalesce(F.concat(F.lit("0"), F.nullif(F.regexp_extract(label, r"(\.\d)$", 1), F.lit(""))).try_cast("double"), F.lit(0.0))
    return F.when(letters != "", value + part).otherwise(label.try_cast("double"))


def nearest(at: Column) -> Column:
    """Nearer of the two bracketing lines; the earlier one on a tie."""
    d = lambda s: F.abs(F.col(s)["pos"] - at)
    pick = F.col("after").isNull() | (d("before") <= d("after"))
    return F.when(pick & F.col("before").isNotNull(), F.col("before")).otherwise(F.col("after"))


def between_label(at: Column, numeric: Column) -> Column:
    """Sub-label such as ``3.4`` or ``B.4`` between two neighbouring labels, null elsewhere."""
    va, vb = label_value(F.col("before.label")), label_value(F.col("after.label"))
    value = va + (vb - va) * (at - F.col("before.pos")) / (F.col("after.pos") - F.col("before.pos"))
    base = F.floor(F.least(va, vb)).cast("int")
    tenth = F.bround((value - base) * 10).cast("int")
    text = F.when(numeric, base.cast("string")).otherwise(F.char(base + 65))
    fits = (F.abs(vb - va) == 1) & (tenth > 0) & (tenth < 10)
    return F.when(fits, F.concat(text, F.lit("."), tenth.cast("string")))


def locate(points: DataFrame, verticals: DataFrame, horizontals: DataFrame, width: float, snap: float = 20.0) -> DataFrame:
    """Nearest intersection of every point, with interpolated labels away from the lines.

    Points (page, id, x, y); lines (page, label, pos). Horizontals carry letters, verticals numbers.
    """
    on_x = bracket(points, verticals, ["page"], "x", "pos", ["label"], width)
    on_x = on_x.withColumns({"v": nearest(F.col("x")), "vi": between_label(F.col("x"), F.lit(True))}).drop("before", "after")
    on_y = bracket(on_x, horizontals, ["page"], "y", "pos", ["label"], width)
    on_y = on_y.withColumns({"h": nearest(F.col("y")), "hi": between_label(F.col("y"), F.lit(False))}).drop("before", "after")
    dx, dy = F.abs(F.col("v.pos") - F.col("x")), F.abs(F.col("h.pos") - F.col("y"))
    vi, hi = F.when(dx > snap, F.col("vi")), F.when(dy > snap, F.col("hi"))
    rx, ry = F.when(vi.isNotNull(), 0.0).otherwise(dx), F.when(hi.isNotNull(), 0.0).otherwise(dy)
    loc = F.concat(F.coalesce(hi, F.col("h.label")), F.lit("-"), F.coalesce(vi, F.col("v.label")))
    return on_y.select(
        *points.columns, loc.alias("loc"), F.sqrt(rx * rx + ry * ry).alias("distance"),
        F.concat(F.col("h.label"), F.lit("-"), F.col("v.label")).alias("coarse"), F.sqrt(dx * dx + dy * dy).alias("coarse_distance"),
    )


def grid_coordinate(points: DataFrame, lines: DataFrame, at: str, width: float, name: str) -> DataFrame:
    """Position in label units: linear between the bracketing lines, carried on past the first and last pair."""
    valued = lines.withColumn("value", label_value(F.col("label")))
    order = ["pos"]
    chunk = F.floor(F.col("pos") / width)
    linked = lag_in_chunks(valued, ["page"], order, chunk, ["pos", "value"], "p_")
    linked = lag_in_chunks(linked, ["page"], order, chunk, ["pos", "value"], "n_", ahead=True)
    found = bracket(points, linked, ["page"], at, "pos", ["value", "p_pos", "p_value", "n_pos", "n_value"], width)
    b, a = F.col("before"), F.col("after")
    lo = F.when(b.isNull(), F.struct(a["pos"].alias("p"), a["value"].alias("v"))).when(
        a.isNull(), F.struct(b["p_pos"].alias("p"), b["p_value"].alias("v"))
    ).otherwise(F.struct(b["pos"].alias("p"), b["value"].alias("v")))
    hi = F.when(b.isNull(), F.struct(a["n_pos"].alias("p"), a["n_value"].alias("v"))).when(
        a.isNull(), F.struct(b["pos"].alias("p"), b["value"].alias("v"))
    ).otherwise(F.struct(a["pos"].alias("p"), a["value"].alias("v")))
    span = F.when(hi["p"] == lo["p"], 1.0).otherwise(hi["p"] - lo["p"])
    value = lo["v"] + (hi["v"] - lo["v"]) * (F.col(at) - lo["p"]) / span
    return found.withColumn(name, F.coalesce(value, F.lit(0.0))).drop("before", "after")


def spacing(lines: DataFrame, width: float, default: float = 150.0) -> DataFrame:
    """Median gap over one between neighbouring lines, both axes together, per page."""
    gaps = lag_in_chunks(lines, ["page", "axis"], ["pos"], F.floor(F.col("pos") / width), ["pos"], "p_")
    kept = gaps.withColumn("gap", F.col("pos") - F.col("p_pos")).where("gap > 1")
    return grouped_quantile(kept, ["page"], {"spacing": F.col("gap")})


def near_cells(points: DataFrame, targets: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Pairs of a point (x, y) and a target (tx, ty) at most one cell apart on both axes; ``size`` is a column of both sides.

    Targets are listed in their nine cells, so a pair meets once.
    """
    cell = lambda x, y: [F.floor(F.col(x) / size).alias("_cx"), F.floor(F.col(y) / size).alias("_cy")]
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_o")
    listed = targets.select("*", *cell("tx", "ty")).select("*", spread).withColumns(
        {"_cx": F.col("_cx") + F.col("_o.i"), "_cy": F.col("_cy") + F.col("_o.j")}
    ).drop("_o")
    return points.select("*", *cell("x", "y")).join(listed.drop("scale"), [*keys, "_cx", "_cy"]).drop("_cx", "_cy")


PERP_TOL, ALONG_TOL, PERP_WEIGHT = 0.42, 0.75, 1.5


def assign_cell(annotations: DataFrame, cells: DataFrame) -> DataFrame:
    """Best cell by along + 1.5 x across distance inside both tolerances, with an ambiguity mark.

    Annotations (page, id, axis, x, y, scale); cells (page, label, tx, ty, scale).
    """
    return _best_cell(near_cells(annotations, cells, ["page"], F.col("scale")))


def assign_crossing(annotations: DataFrame, verticals: DataFrame, horizontals: DataFrame, scale: float) -> DataFrame:
    """``assign_cell`` where the cells are the crossings of all lines of a page.

    Lines (page, label, pos). Lines are found on one axis after the other, each listed in three stretches, so
    only crossings next to an annotation are made.
    """
    stretch = lambda c: F.floor(F.col(c) / scale)

    def listed(lines: DataFrame, label: str, pos: str) -> DataFrame:
        spread = F.explode(F.array(*[stretch("pos") + i for i in (-1, 0, 1)])).alias("_c")
        return lines.select("page", F.col("label").alias(label), F.col("pos").alias(pos), spread)

    rows = annotations.withColumn("scale", F.lit(scale)).withColumn("_c", stretch("x"))
    across = rows.join(listed(verticals, "_v", "tx"), ["page", "_c"]).where(F.abs(F.col("x") - F.col("tx")) <= ALONG_TOL * scale)
    near = across.withColumn("_c", stretch("y")).join(listed(horizontals, "_h", "ty"), ["page", "_c"])
    return _best_cell(near.withColumn("label", F.concat_ws("-", "_h", "_v")))


def _best_cell(near: DataFrame) -> DataFrame:
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    perp, along = F.when(F.col("axis") == "H", dy).otherwise(dx), F.when(F.col("axis") == "H", dx).otherwise(dy)
    inside = (F.abs(perp) <= PERP_TOL * F.col("scale")) & (F.abs(along) <= ALONG_TOL * F.col("scale"))
    scored = near.where(inside).withColumn("score", F.abs(along) + PERP_WEIGHT * F.abs(perp))
    two = top_per_key(scored, ["page", "id"], [F.asc("score"), F.asc("label")], 2)
    out = two.groupBy("page", "id", "scale").agg(
        F.max(F.when(F.col("rn") == 1, F.col("label"))).alias("label"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"),
    )
    unsure = F.col("second") < 1.3 * F.col("score") + 0.05 * F.col("scale")
    return out.withColumn("ambiguous", F.coalesce(unsure, F.lit(False)).cast("int"))


def boxes_by_cell(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes (page, box, x0, y0, x1, y1) under the cells they cover, as far as they can be the smallest box there.

    Of boxes with the same corners the first one stands for all; and in a cell that a box covers whole, no box
    that comes after it by area and name can be the answer, so it is not listed there.
    """
    corners = ["x0", "y0", "x1", "y1"]
    steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    distinct = boxes.groupBy("page", *corners).agg(F.min("box").alias("box")).withColumn("_rank", F.struct(box_area().alias("area"), "box"))
    spread = distinct.withColumn("_cx", F.explode(steps("x0", "x1"))).withColumn("_cy", F.explode(steps("y0", "y1")))
    whole = lambda c, lo, hi: (F.col(lo) <= F.col(c) * size) & (F.col(hi) >= (F.col(c) + 1) * size)
    covering = F.when(whole("_cx", "x0", "x1") & whole("_cy", "y0", "y1"), F.col("_rank"))
    first = spread.groupBy("page", "_cx", "_cy").agg(F.min(covering).alias("_first"))
    kept = F.col("_first").isNull() | (F.col("_rank") <= F.col("_first"))
    return spread.join(first, ["page", "_cx", "_cy"]).where(kept).drop("_rank", "_first")


def box_area() -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def containing_box(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Smallest box that holds each point, the first one by name on a tie."""
    placed = points.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    inside = placed.join(boxes_by_cell(boxes, size), ["page", "_cx", "_cy"]).where(
        F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    )
    return top_per_key(inside, ["page", "id"], [box_area().asc(), F.asc("box")]).select("page", "id", "box", box_area().alias("area"))


def corner_locate(boxes: DataFrame, verticals: DataFrame, horizontals: DataFrame, width: float, reach: float = 20.0) -> DataFrame:
    """Nearest intersection from four anchors around a box; each anchor has a fixed penalty."""
    anchors = F.explode(
        F.array(
            F.struct((F.col("x1") + reach).alias("ax"), F.col("y0").alias("ay"), F.lit(0.0).alias("penalty")),
            F.struct((F.col("x0") - reach).alias("ax"), F.col("y0").alias("ay"), F.lit(15.0).alias("penalty")),
            F.struct((F.col("x1") + reach).alias("ax"), F.col("y1").alias("ay"), F.lit(25.0).alias("penalty")),
            F.struct((F.col("x0") - reach).alias("ax"), F.col("y1").alias("ay"), F.lit(25.0).alias("penalty")),
        )
    ).alias("a")
    points = boxes.select("page", "id", anchors).select("page", "id", F.col("a.ax").alias("x"), F.col("a.ay").alias("y"), "a.penalty")
    found = locate(points, verticals, horizontals, width)
    best = F.min(F.struct((F.col("coarse_distance") + F.col("penalty")).alias("cost"), "penalty", "coarse", F.col("coarse_distance").alias("distance")))
    return found.where(F.col("coarse").isNotNull()).groupBy("page", "id").agg(best.alias("b")).select(
        "page", "id", F.col("b.coarse").alias("loc"), F.col("b.distance").alias("distance"), F.col("b.penalty").alias("penalty")
    )


def level_band(points: DataFrame, marks: DataFrame, gap: float, width: float) -> DataFrame:
    """Level below and above each point, in the level column nearest to its left (else the first to its right).

    Points (page, id, x, y); marks (page, mark, mx, my, level).
    """
    columned = cluster(marks, ["page"], "mx", "mark", gap, width, "column", strict=True)
    heads = columned.groupBy("page", "column").agg(F.min("mx").alias("pos"))
    placed = bracket(points, heads, ["page"], "x", "pos", ["column"], width)
    placed = placed.withColumn("column", F.coalesce("before.column", "after.column")).drop("before", "after")
    levels = columned.select("page", "column", F.col("my").alias("pos"), "level")
    found = bracket(placed, levels, ["page", "column"], "y", "pos", ["level"], width)
    return found.select(*points.columns, F.col("after.level").alias("lower"), F.col("before.level").alias("upper"))


def header_level(blocks: DataFrame, heads: DataFrame, levels: DataFrame, width: float, share: float = 0.75) -> DataFrame:
    """Nearest column header within 0.75 pitch of each block, and the first level mark under the block.

    Blocks (page, id, x, y, part); heads (page, loc, pos); levels (page, level, pos).
    """
    gaps = lag_in_chunks(heads, ["page"], ["pos"], F.floor(F.col("pos") / width), ["pos"], "p_")
    pitch = gaps.groupBy("page").agg(F.min(F.col("pos") - F.col("p_pos")).alias("pitch"))
    near = bracket(blocks, heads, ["page"], "x", "pos", ["loc"], width).withColumn("head", nearest(F.col("x"))).drop("before", "after")
    near = near.join(pitch, "page").where(F.abs(F.col("head.pos") - F.col("x")) <= share * F.col("pitch"))
    under = bracket(near, levels, ["page"], "y", "pos", ["level"], width)
    rows = under.select("page", "id", "part", F.col("head.loc").alias("loc"), F.col("after.level").alias("level")).where("level IS NOT NULL")
    return top_per_key(rows, ["loc", "level"], [F.desc("part"), F.asc("id")]).drop("rn")


def fill_gaps(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of another layout only where the first one has none."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def split_at_gap(rows: DataFrame, keys: list[str], at: str, height: str, factor: float = 1.2) -> DataFrame:
    """Middle of the largest gap of each group when it passes ``factor`` x median height, else null.

    Positions are reduced to distinct ones before neighbours are compared.
    """
    distinct = rows.select(*keys, at).distinct()
    gaps = lag_in_chunks(distinct, keys, [at], F.floor(F.col(at) / 64), [at], "p_").where(F.col(f"p_{at}").isNotNull())
    biggest = gaps.groupBy(*keys).agg(
        F.max(F.struct((F.col(at) - F.col(f"p_{at}")).alias("gap"), (-F.col(at)).alias("hi"), F.col(f"p_{at}").alias("lo"))).alias("g")
    )
    heights = grouped_quantile(rows, keys, {"h": F.col(height)})
    return heights.join(biggest, keys, "left").select(
        *keys, F.when(F.col("g.gap") > factor * F.col("h"), (-F.col("g.hi") + F.col("g.lo")) / 2).alias("split")
    )


def view_regions(titles: DataFrame, width: float, tol: float) -> DataFrame:
    """Half-way borders between the titles of a row; the outer sides take 1.3 x the inner half, or two title widths."""
    rowed = cluster(titles, ["page"], "y", "id", tol, width, "row")
    chunk = F.floor(F.col("x") / width)
    linked = lag_in_chunks(rowed, ["page", "row"], ["x", "id"], chunk, ["x"], "p_")
    linked = lag_in_chunks(linked, ["page", "row"], ["x", "id"], chunk, ["x"], "n_", ahead=True)
    left, right = (F.col("x") - F.col("p_x")) / 2, (F.col("n_x") - F.col("x")) / 2
    wide = 2.0 * F.col("w")
    return linked.select(
        "page", "id", "row", (F.col("x") - F.coalesce(left, 1.3 * right, wide)).alias("x0"),
        (F.col("x") + F.coalesce(right, 1.3 * left, wide)).alias("x1"),
    )


def to_frame(lines: DataFrame) -> DataFrame:
    """Turn the pages whose texts mostly run upward: (x, y) becomes (height - y, x)."""
    turned = lines.groupBy("page").agg((F.count_if(F.col("up")) * 2 > F.count(F.lit(1))).alias("turned"))
    t = F.col("turned")
    return lines.join(turned, "page").withColumns(
        {"nx": F.when(t, F.col("height") - F.col("y")).otherwise(F.col("x")), "ny": F.when(t, F.col("x")).otherwise(F.col("y"))}
    ).drop("turned")


def table_rows(cells: DataFrame, heads: DataFrame, tol: float, width: float) -> DataFrame:
    """Row number and header of each cell below its table's header: rows by height, header by nearest start.

    Cells (page, id, x, y, body); heads (page, name, pos, top).
    """
    top = heads.groupBy("page").agg(F.max("top").alias("top"))
    below = cells.join(top, "page").where(F.col("y") > F.col("top"))
    rowed = cluster(below, ["page"], "y", "id", tol, width, "row")
    placed = bracket(rowed, heads, ["page"], "x", "pos", ["name"], width)
    return placed.withColumn("head", nearest(F.col("x"))).select("page", "id", "row", F.col("head.name").alias("header"), "body")


def paired_lines(labels: DataFrame, kind: str, axis: str, span: str, share: float, tol: float, width: float) -> DataFrame:
    """Grid lines named by equal labels on both sides of a page: labels (page, id, text, cx, cy, size, extent)."""
    rows = cluster(labels.where(F.col("text").rlike(kind)), ["page"], axis, "id", tol, width, "c")
    groups = rows.groupBy("page", "c", "text").agg(
        F.count(F.lit(1)).alias("n"), (F.max(span) - F.min(span)).alias("reach"), F.max("extent").alias("extent")
    )
    kept = groups.where((F.col("n") >= 2) & (F.col("reach") > share * F.col("extent")))
    medians = grouped_quantile(rows.join(kept.select("page", "c", "text"), ["page", "c", "text"]), ["page", "c", "text"], {"pos": F.col(axis), "size": F.col("size")})
    return medians.select("page", F.col("text").alias("label"), "pos", "size")


NUMBERS, LETTERS = r"^\d{1,2}(\.\d)?$", r"^([A-Z])\1?(\.\d)?$"


def _on_band(lone: DataFrame, labels: DataFrame, paired: DataFrame, tol: float = 3.0) -> DataFrame:
    """Labels on the same edge band as the paired ones: bands are rounded and listed in three cells."""
    members = labels.select("page", F.col("text").alias("label"), "cx", "cy").join(
        paired.select("page", "axis", "label", "pos"), ["page", "label"]
    )
    vertical = F.col("axis") == "V"
    on_line = F.abs(F.when(vertical, F.col("cx")).otherwise(F.col("cy")) - F.col("pos")) < 4
    band = F.bround(F.when(vertical, F.col("cy")).otherwise(F.col("cx")))
    bands = members.where(on_line).select("page", "axis", band.alias("band")).distinct()
    cells = bands.withColumn("_c", F.explode(F.array(*[F.floor(F.col("band") / tol) + k for k in (-1, 0, 1)])))
    at = F.when(vertical, F.col("cy")).otherwise(F.col("cx"))
    near = lone.withColumn("_at", at).withColumn("_c", F.floor(F.col("_at") / tol)).join(cells, ["page", "axis", "_c"])
    return near.where(F.abs(F.col("_at") - F.col("band")) < tol).drop("_at", "_c", "band").dropDuplicates(["page", "axis", "id"])


def detect_grid(labels: DataFrame, width: float, tol: float = 3.0, share: float = 0.3) -> DataFrame:
    """Lines of both axes of each page: paired labels, orientation by vote, then lone labels of the same size."""
    sides = {
        ("V", "num"): paired_lines(labels, NUMBERS, "cx", "cy", share, tol, width),
        ("V", "let"): paired_lines(labels, LETTERS, "cx", "cy", share, tol, width),
        ("H", "num"): paired_lines(labels, NUMBERS, "cy", "cx", share, tol, width),
        ("H", "let"): paired_lines(labels, LETTERS, "cy", "cx", share, tol, width),
    }
    found = None
    for (axis, kind), df in sides.items():
        part = df.select("page", F.lit(axis).alias("axis"), F.lit(kind).alias("kind"), "label", "pos", "size")
        found = part if found is None else found.unionByName(part)
    found = cut_lineage(found)  # a few lines per page, read by the vote, the sizes and the bands
    lettered = ((F.col("axis") == "V") & (F.col("kind") == "let")) | ((F.col("axis") == "H") & (F.col("kind") == "num"))
    votes = found.groupBy("page").agg((F.count_if(lettered) > F.count_if(~lettered)).alias("turned"))
    paired = cut_lineage(found.join(votes, "page").where(F.col("turned") == lettered))
    sizes = grouped_quantile(paired, ["page", "axis", "kind"], {"ref": F.col("size")})
    known = paired.select("page", "axis", "label").distinct()
    kinds = labels.select(
        "page", F.col("text").alias("label"), "size", "cx", "cy", "id",
        F.when(F.col("text").rlike(NUMBERS), "num").when(F.col("text").rlike(LETTERS), "let").alias("kind"),
    )
    lone = kinds.join(sizes, ["page", "kind"]).where(F.abs(F.col("size") - F.col("ref")) < 0.15 * F.col("ref"))
    lone = _on_band(lone, labels, paired).join(known, ["page", "axis", "label"], "left_anti").withColumn("pos", F.when(F.col("axis") == "V", F.col("cx")).otherwise(F.col("cy")))
    first = lone.groupBy("page", "axis", "label").agg(F.min(F.struct("id", "pos")).alias("f")).select("page", "axis", "label", F.col("f.pos").alias("pos"))
    return paired.select("page", "axis", "label", "pos", F.lit(1).alias("paired")).unionByName(first.withColumn("paired", F.lit(0)))


def tag_items(tags: DataFrame, rows: DataFrame, bounds: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Tags equal to a table-row code, inside the grid bounds and outside the table boxes, with the bars of that row."""
    coded = tags.join(rows, ["page", "code"])
    margin = coded.join(bounds, "page").where(F.col("x").between(F.col("lo_x"), F.col("hi_x")) & F.col("y").between(F.col("lo_y"), F.col("hi_y")))
    covered = containing_box(margin.select("page", "id", "x", "y"), boxes, size)
    return margin.join(covered.select("page", "id"), ["page", "id"], "left_anti").select("page", "id", "code", "bars")
