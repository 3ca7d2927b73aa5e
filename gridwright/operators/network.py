"""Proximity network of pipes and manholes: nearest joins, degrees, components, crossings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridwright.functions.values import fixed_sum, rounded
from gridwright.operators.components import connected_components
from gridwright.operators.layer_rules import MANHOLE, PIPE, findings, first_path
from gridwright.operators.ranking import number_rows
from gridwright.session import cut, settle


def pipe_endpoints(pipes: DataFrame) -> DataFrame:
    """``objectid, asset_id, end, x, y``: first and last vertex of paths with two or more."""
    ends = F.array(
        F.struct(F.lit("start").alias("end"), F.get(first_path(), F.lit(0)).alias("p")),
        F.struct(F.lit("end").alias("end"), F.element_at(first_path(), -1).alias("p")),
    )
    d = pipes.where(F.size(first_path()) >= 2).select("objectid", "asset_id", F.explode(ends).alias("e"))
    return d.select("objectid", "asset_id", "e.end", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def _around() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))


#: How much wider the cells of each further round of ``nearest`` are.
WIDER = 4


def nearest(points: DataFrame, targets: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """For each point the nearest target anywhere: its columns and ``near_id, near_asset, distance``.

    Equal distances go to the smaller ``ordinal``. A round looks for the targets of a point in the
    grid cells around its own, which hold all targets within the width of a cell; points whose
    nearest one is within that width are settled, the others go on with cells four times as wide.
    While points are many, the targets are laid on the cells around theirs and the points on their
    own alone, so a point is shuffled once a round and its targets meet it where they are compared.
    Targets at one place count as the one of the smallest ordinal.
    """
    finite = lambda *cs: reduce(Column.__and__, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in cs])
    place = F.min(F.struct("ordinal", F.col("objectid").alias("near_id"), F.col("asset_id").alias("near_asset"))).alias("t")
    marks = targets.where(finite(F.col("x"), F.col("y"))).groupBy(F.col("x").alias("mx"), F.col("y").alias("my")).agg(place)
    marks = settle(marks.select("mx", "my", "t.*"))
    n_marks, n_rest, size, columns = marks.count(), None, float(reach), points.columns
    square = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
    best = F.min(F.when(F.col("mx").isNotNull(), F.struct(square.alias("d2"), "ordinal", "near_id", "near_asset"))).alias("best")
    result = lambda d: d.select(*columns, F.col("best.near_id").alias("near_id"), F.col("best.near_asset").alias("near_asset"), F.sqrt("best.d2").alias("distance"))
    placed = finite(F.col("x"), F.col("y")) if n_marks else F.lit(False)
    alone = points.where(~placed).join(marks.limit(0).drop("mx", "my"), F.lit(False), "left").withColumn("distance", F.lit(None).cast("double"))
    found, rest = alone.select(*columns, "near_id", "near_asset", "distance"), points.where(placed)
    while n_marks and n_rest != 0:
        own = lambda d, x, y, size=size: d.withColumns({"cx": _cell(F.col(x), size), "cy": _cell(F.col(y), size)})
        spread = lambda d: d.withColumn("s", _around()).withColumns({"cx": F.col("cx") + F.col("s.dx"), "cy": F.col("cy") + F.col("s.dy")}).drop("s")
        if n_rest is None or n_rest > n_marks:
            pairs = own(rest, "x", "y").join(spread(own(marks, "mx", "my")), ["cx", "cy"], "left")
            tried = pairs.groupBy("cx", "cy", *columns).agg(best)  # by the cells too: the rows are there already
        else:
            pairs = spread(own(rest.select(*keys, "x", "y"), "x", "y")).join(own(marks, "mx", "my"), ["cx", "cy"])
            tried = rest.join(pairs.groupBy(*keys).agg(best), keys, "left")
        watch = Observation()
        open_ = F.coalesce(F.col("best.d2") > size * size, F.lit(True))
        tried = settle(tried.select(*columns, "best", open_.alias("open")).observe(watch, F.count_if("open").alias("rest")))
        found, rest = found.unionByName(result(tried.where("NOT open"))), tried.where("open").select(*columns)
        n_rest, size = watch.get["rest"], size * WIDER
    return found


def match_endpoints(pipes: DataFrame, manholes: DataFrame, reach: float = 10.0) -> DataFrame:
    points = manholes.where("geometry.type = 'point'").select("objectid", "asset_id", "ordinal", F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y"))
    return nearest(pipe_endpoints(pipes), points, reach, ["objectid", "end"])


def gap_findings(matches: DataFrame, tolerance: float = 3.0, warning: float = 10.0) -> DataFrame:
    far = lambda t: matches.where(F.col("near_id").isNull() | (F.col("distance") > t))
    make = lambda rows, code: findings(rows, code, PIPE, F.col("end"), F.col("near_id"))
    return make(far(tolerance), "WW_NET_001").unionByName(make(far(warning), "WW_NET_003"))


def manhole_degrees(matches: DataFrame, manholes: DataFrame, tolerance: float = 3.0) -> DataFrame:
    degree = matches.where(F.col("distance") <= tolerance).groupBy("near_id").agg(F.count("*").alias("degree"))
    joined = manholes.join(degree.withColumnRenamed("near_id", "objectid"), "objectid", "left")
    return joined.withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def degree_findings(degrees: DataFrame, high: int = 6) -> DataFrame:
    """A manhole without a pipe end gives two findings, one with too many gives one."""
    codes = F.explode(F.when(F.col("degree") == 0, F.array(F.lit("WW_NET_002"), F.lit("WW_NET_007"))).when(F.col("degree") > high, F.array(F.lit("WW_NET_008"))))
    d = degrees.withColumn("code", codes)
    return d.select(F.col("code").alias("rule_code"), F.lit(MANHOLE).alias("source_layer"), F.col("objectid").cast("string").alias("source_objectid"), "degree")


def components(pipes: DataFrame, manholes: DataFrame, matches: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``kind, objectid, ordinal, component``: proximity components over matched pipe ends.

    Node numbers are twice the manhole's id, and twice the pipe's id plus one; a component is
    named by its smallest node. A pipe is a link between the manholes at its ends, so components
    are those of the manholes, over each linked pair once, and pipes join the one of a manhole.
    """
    ends = matches.where(F.col("distance") <= tolerance).groupBy("objectid").agg(F.collect_set("near_id").alias("near"))
    ends = settle(ends.select("objectid", F.array_min("near").alias("root"), F.filter("near", lambda x: x > F.array_min("near")).alias("others")))
    placed = connected_components(ends.select(F.col("root").alias("a"), F.explode("others").alias("b"))).withColumnRenamed("id", "root")
    of_pipe = pipes.select(F.lit("pipe").alias("kind"), "objectid", "ordinal").join(ends.drop("others"), "objectid", "left")
    of_manhole = manholes.select(F.lit("manhole").alias("kind"), "objectid", "ordinal", F.col("objectid").alias("root"))
    nodes = of_pipe.unionByName(of_manhole).join(placed, "root", "left").withColumn("root", F.coalesce("component", "root")).drop("component")
    nodes = settle(nodes.withColumn("id", F.col("objectid") * 2 + F.when(F.col("kind") == "pipe", 1).otherwise(0)))
    names = nodes.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component"))
    return settle(nodes.join(names, "root", "left").select("kind", "objectid", "ordinal", F.coalesce("component", "id").alias("component")))


def component_table(members: DataFrame) -> DataFrame:
    """``component_id, component, pipe_count, manhole_count, pipe_objectids, manhole_objectids``.

    Ids count from 1 by pipes, then manholes, both descending; equal ones in order of their first
    manhole, those without manholes last by first pipe.
    """
    of = lambda kind: F.col("kind") == kind
    ids = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(of(kind), F.col("objectid")))), lambda x: x.cast("string"))
    t = members.groupBy("component").agg(
        F.count_if(of("pipe")).alias("pipe_count"),
        F.count_if(of("manhole")).alias("manhole_count"),
        F.array_join(ids("pipe"), ";").alias("pipe_objectids"),
        F.array_join(ids("manhole"), ";").alias("manhole_objectids"),
        F.min(F.when(of("manhole"), F.col("ordinal"))).alias("_m"),
        F.min(F.when(of("pipe"), F.col("ordinal"))).alias("_p"),
    )
    order = [F.desc("pipe_count"), F.desc("manhole_count"), F.asc_nulls_last("_m"), F.asc_nulls_last("_p")]
    return number_rows(t, order, "component_id").drop("_m", "_p")


def component_findings(table: DataFrame) -> DataFrame:
    """``rule_code, component_id``: apart from the largest one with pipes; a single pipe."""
    largest = table.agg(F.max(F.col("pipe_count") + F.col("manhole_count")).alias("largest"))
    d = table.join(F.broadcast(largest))  # one row
    apart = d.where("pipe_count > 0 AND pipe_count + manhole_count < largest").select(F.lit("WW_NET_005").alias("rule_code"), "component")
    return apart.unionByName(table.where("pipe_count = 1").select(F.lit("WW_NET_006").alias("rule_code"), "component"))


def network_summary(table: DataFrame, matches: DataFrame, degrees: DataFrame, tolerance: float = 3.0, high: int = 6) -> DataFrame:
    size = F.col("pipe_count") + F.col("manhole_count")
    a = table.agg(
        F.count("*").alias("components"), F.max(size).alias("largest_size"), F.max("pipe_count").alias("largest_pipes"),
        F.count_if(size == 1).alias("isolated_components"), F.count_if(F.col("pipe_count") == 1).alias("isolated_pipes"),
        F.count_if((F.col("pipe_count") == 0) & (F.col("manhole_count") == 1)).alias("isolated_manholes"),
    )
    hit = F.col("distance") <= tolerance
    b = matches.agg(
        F.count_if(hit).alias("matched"), F.count("*").alias("_all"), (fixed_sum(F.when(hit, F.col("distance"))) / F.nullif(F.count_if(hit), F.lit(0))).alias("mean"), F.max(F.when(hit, F.col("distance"))).alias("max_distance")
    )
    c = degrees.agg(F.count_if(F.col("degree") > high).alias("high_degree"))
    one = a.join(b).join(c)  # three single rows
    return one.select(
        "components", "largest_size", "largest_pipes", "isolated_components", "isolated_pipes", "isolated_manholes", "matched",
        (F.col("_all") - F.col("matched")).alias("unmatched"),
        rounded(F.col("matched") / F.greatest(F.col("_all"), F.lit(1)), 4).alias("match_rate"),
        rounded(F.coalesce("mean", F.lit(0.0)), 4).alias("mean_distance"), rounded(F.coalesce("max_distance", F.lit(0.0)), 4).alias("max_distance"), "high_degree",
    )


def segments(pipes: DataFrame) -> DataFrame:
    d = pipes.where(F.size(first_path()) >= 2).select("objectid", "ordinal", first_path().alias("p"))
    d = d.select("objectid", "ordinal", "p", (F.size("p") > 2).alias("long"), F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("i", "a"))
    d = d.withColumn("b", F.get("p", F.col("i") + 1))
    return d.select("objectid", "ordinal", "i", "long", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def crossings(pipes: DataFrame, manholes: DataFrame, tolerance: float = 3.0, cell: float = 50.0) -> DataFrame:
    """``objectid, related_objectid, x, y``: pipes that cross away from vertices and manholes.

    Segments meet in the grid cells of their bounding boxes (two meeting segments share the cell
    of the lower corner of the boxes' overlap, so a pair is looked at once). Of each pair of
    pipes the first meeting segments count, before vertices and manholes are considered.
    """
    box = lambda p: [f(F.col(f"{p}a{c}"), F.col(f"{p}b{c}")) for c in "xy" for f in (F.least, F.greatest)]
    x0, x1, y0, y1 = box("")
    # boxes are made again behind the exchange; it carries the ends of a segment alone
    s = segments(pipes)
    s = s.withColumn("cx", F.explode(F.sequence(_cell(x0, cell), _cell(x1, cell)))).withColumn("cy", F.explode(F.sequence(_cell(y0, cell), _cell(y1, cell))))
    left = s.select("cx", "cy", *[F.col(c).alias("l_" + c) for c in s.columns if c not in ("cx", "cy")])
    right = s.select("cx", "cy", *[F.col(c).alias("r_" + c) for c in s.columns if c not in ("cx", "cy")])
    (lx0, lx1, ly0, ly1), (rx0, rx1, ry0, ry1) = box("l_"), box("r_")
    meet = (
        (F.col("l_ordinal") < F.col("r_ordinal")) & (lx0 <= rx1) & (rx0 <= lx1) & (ly0 <= ry1) & (ry0 <= ly1)
        & (F.col("cx") == _cell(F.greatest(lx0, rx0), cell)) & (F.col("cy") == _cell(F.greatest(ly0, ry0), cell))
    )
    p = left.join(right.withColumnsRenamed({"cx": "_cx", "cy": "_cy"}), (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & meet)
    den = (F.col("l_ax") - F.col("l_bx")) * (F.col("r_ay") - F.col("r_by")) - (F.col("l_ay") - F.col("l_by")) * (F.col("r_ax") - F.col("r_bx"))
    p = p.withColumn("den", den).where(F.abs("den") >= 1e-9)
    t = ((F.col("l_ax") - F.col("r_ax")) * (F.col("r_ay") - F.col("r_by")) - (F.col("l_ay") - F.col("r_ay")) * (F.col("r_ax") - F.col("r_bx"))) / F.col("den")
    u = -((F.col("l_ax") - F.col("l_bx")) * (F.col("l_ay") - F.col("r_ay")) - (F.col("l_ay") - F.col("l_by")) * (F.col("l_ax") - F.col("r_ax"))) / F.col("den")
    p = p.withColumn("t", t).withColumn("u", u).where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    p = p.withColumns({"x": F.col("l_ax") + F.col("t") * (F.col("l_bx") - F.col("l_ax")), "y": F.col("l_ay") + F.col("t") * (F.col("l_by") - F.col("l_ay"))})
    close = lambda vx, vy: (vx - F.col("x")) * (vx - F.col("x")) + (vy - F.col("y")) * (vy - F.col("y")) <= 1e-6
    # the ends of both segments are vertices: most pairs meet there and go no further than this aggregate
    own = reduce(Column.__or__, [F.coalesce(close(F.col(e + "x"), F.col(e + "y")), F.lit(False)) for e in ("l_a", "l_b", "r_a", "r_b")])
    first = p.groupBy(F.col("l_objectid").alias("objectid"), F.col("r_objectid").alias("related_objectid")).agg(F.min(F.struct("l_i", "r_i", "x", "y", own.alias("own"), (F.col("l_long") | F.col("r_long")).alias("long"))).alias("m"))
    first = settle(first.where("NOT m.own").select("objectid", "related_objectid", "m.x", "m.y", "m.long"))
    vertices = pipes.select("objectid", first_path().alias("path"))
    d = first.where("long").join(vertices, "objectid").join(vertices.select(F.col("objectid").alias("related_objectid"), F.col("path").alias("path2")), "related_objectid")
    d = d.where(~F.exists(F.concat("path", "path2"), lambda v: close(v["x"], v["y"])))
    names = ["objectid", "related_objectid", "x", "y"]
    d = first.where("NOT long").select(*names).unionByName(d.select(*names)).withColumn("cx", _cell(F.col("x"), tolerance)).withColumn("cy", _cell(F.col("y"), tolerance))
    marks = manholes.where("geometry.type = 'point'").select(F.col("geometry.x").alias("mx"), F.col("geometry.y").alias("my")).withColumn("s", _around())
    marks = marks.select("mx", "my", (_cell(F.col("mx"), tolerance) + F.col("s.dx")).alias("_cx"), (_cell(F.col("my"), tolerance) + F.col("s.dy")).alias("_cy"))
    square = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
    return d.join(marks, (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & (square <= tolerance * tolerance), "left_anti").select(*names)


def component_extents(members: DataFrame, pipes: DataFrame, manholes: DataFrame, gaps: DataFrame, primary: int = 500) -> DataFrame:
    """Per component: counts, pipe length, unmatched ends (findings of ``gap_findings``), box and mean
    vertex to two digits, whether it is isolated, and a likely class."""
    points = pipes.select(F.lit("pipe").alias("kind"), "objectid", F.explode(first_path()).alias("p")).unionByName(
        manholes.where("geometry.type = 'point'").select(F.lit("manhole").alias("kind"), "objectid", F.struct(F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y")).alias("p"))
    )
    where = members.select("kind", "objectid", "component")
    two = lambda c: rounded(c, 2)
    mean = lambda c: fixed_sum(F.col(c)) / F.count(c)
    box = points.join(where, ["kind", "objectid"]).groupBy("component").agg(
        two(F.min("p.x")).alias("x_min"), two(F.max("p.x")).alias("x_max"), two(F.min("p.y")).alias("y_min"), two(F.max("p.y")).alias("y_max"), two(mean("p.x")).alias("cx"), two(mean("p.y")).alias("cy")
    )
    lengths = pipes.select(F.lit("pipe").alias("kind"), "objectid", F.coalesce("geometry.length", F.lit(0.0)).alias("length"))
    ends = gaps.groupBy("source_objectid").agg(F.count("*").alias("gaps")).select(F.lit("pipe").alias("kind"), F.col("source_objectid").cast("long").alias("objectid"), "gaps")
    counts = where.join(lengths, ["kind", "objectid"], "left").join(ends, ["kind", "objectid"], "left").groupBy("component").agg(
        F.count_if(F.col("kind") == "pipe").alias("pipe_count"), F.count_if(F.col("kind") == "manhole").alias("manhole_count"),
        two(F.coalesce(fixed_sum(F.col("length")), F.lit(0.0))).alias("total_length"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("unmatched_endpoints"),
    )
    total = F.col("pipe_count") + F.col("manhole_count")
    return counts.join(box, "component", "left").withColumns({
        "isolated_status": F.when(total <= 1, "isolated").otherwise("connected_component"), "likely_class": F.when(total > primary, "primary_network").otherwise("unknown"),
    })


def nearest_component(extents: DataFrame, reach: float = 200.0) -> DataFrame:
    """Distance from each component's centre to the nearest other centre, 2 digits; null alone."""
    c = settle(extents.where("cx IS NOT NULL").select("component", "cx", "cy"))
    cells = lambda d, p: d.select(F.col("component").alias(p + "c"), F.col("cx").alias(p + "x"), F.col("cy").alias(p + "y"))
    found, size, rest = None, reach, c
    for _ in range(24):
        a = cells(rest, "a").withColumn("gx", _cell(F.col("ax"), size)).withColumn("gy", _cell(F.col("ay"), size))
        b = cells(c, "b").withColumn("s", _around()).withColumn("gx", _cell(F.col("bx"), size) + F.col("s.dx")).withColumn("gy", _cell(F.col("by"), size) + F.col("s.dy")).drop("s")
        near = a.join(b, ["gx", "gy"]).where("ac <> bc").withColumn("d2", (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
        best = cut(near.groupBy("gx", "gy", F.col("ac").alias("component")).agg(F.min("d2").alias("d2")).where(F.col("d2") <= size * size).select("component", "d2"))
        found = best if found is None else found.unionByName(best)
        rest = cut(rest.join(best, "component", "left_anti"))
        if rest.limit(2).count() < 1 or c.limit(2).count() < 2:
            break
        size *= 4
    return c.join(found, "component", "left").select("component", rounded(F.sqrt("d2"), 2).alias("nearest_distance"))


def extents_overlap(layers: DataFrame, anchors: DataFrame) -> DataFrame:
    """Layers whose box meets any anchor layer's box under the same spatial reference.

    Both sides: ``layer_id, srs, x_min, x_max, y_min, y_max``. The join is an equi-join on the
    reference; boxes are compared inside.
    """
    a = anchors.select(*[F.col(c).alias("a_" + c) for c in ("srs", "x_min", "x_max", "y_min", "y_max")])
    meets = (F.col("srs") == F.col("a_srs")) & (F.col("x_min") <= F.col("a_x_max")) & (F.col("a_x_min") <= F.col("x_max")) & (F.col("y_min") <= F.col("a_y_max")) & (F.col("a_y_min") <= F.col("y_max"))
    return layers.join(a, meets, "left_semi")
