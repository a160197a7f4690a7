"""Queries over scenes, images whose number grows with the part table, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.operators import basins, colours, frames, geometry, links, raster, strategies
from sievestone.sources import specimens as s

from .catalogue import query, rounded

LAST = s.SCENE - 1
BLOCK = 15


def _sums_sql(name: str, source: str, weights: tuple, mirrored: bool) -> str:
    """Weighted sums along x, then along y, by a join with the weights' places."""
    r = len(weights) // 2
    w = ", ".join(f"({k - r}, {x!r}{'::DOUBLE' if isinstance(x, float) else ''})" for k, x in enumerate(weights))
    end = (lambda c: f"abs({LAST} - abs({LAST} - ({c} + d)))") if mirrored else (lambda c: f"greatest(0, least({LAST}, {c} + d))")
    return f"""{name}_w AS (SELECT * FROM (VALUES {w}) t(d, w)), {name}_x AS (SELECT a.run_id, a.y, a.x, sum(b.v * w) AS v FROM (SELECT *, {end("x")} AS at FROM {source}, {name}_w) a JOIN {source} b ON a.run_id = b.run_id AND a.y = b.y AND b.x = a.at GROUP BY 1, 2, 3),
    {name} AS (SELECT a.run_id, a.y, a.x, sum(b.v * w) AS s FROM (SELECT *, {end("y")} AS at FROM {name}_x, {name}_w) a JOIN {name}_x b ON a.run_id = b.run_id AND a.x = b.x AND b.y = a.at GROUP BY 1, 2, 3)"""


@query(f"WITH {s.SCENES_SQL}, {_sums_sql('g', 'scene', frames.BINOMIAL, True)} SELECT run_id, y, x, ((s + 128) // 256)::BIGINT AS v FROM g")
def gaussian_blur(spark, sf_dir):
    return raster.denoise(s.scenes(spark, sf_dir))


def _equal_sql(clip: float, tiles: int = 8) -> str:
    t = s.SCENE // tiles
    limit = max(1, int(clip * t * t / 256))
    corner = lambda k, y, x: f"JOIN curve {k} ON p.run_id = {k}.run_id AND p.v = {k}.v AND {k}.ty = greatest(0, least({tiles - 1}, {y})) AND {k}.tx = greatest(0, least({tiles - 1}, {x}))"
    return f"""tile AS (SELECT run_id, y // {t} AS ty, x // {t} AS tx, v, count(*) AS n FROM scene GROUP BY 1, 2, 3, 4), over AS (SELECT run_id, ty, tx, sum(greatest(0, n - {limit}))::BIGINT AS e FROM tile GROUP BY 1, 2, 3),
    level AS (SELECT o.run_id, o.ty, o.tx, k AS v, least(coalesce(n, 0), {limit}) + e // 256 + CASE WHEN e % 256 > 0 AND k % greatest(1, 256 // greatest(1, e % 256)) = 0 AND k // greatest(1, 256 // greatest(1, e % 256)) < e % 256 THEN 1 ELSE 0 END AS n
        FROM (SELECT *, unnest(range(256)) AS k FROM over) o LEFT JOIN tile i ON o.run_id = i.run_id AND o.ty = i.ty AND o.tx = i.tx AND o.k = i.v),
    curve AS (SELECT run_id, ty, tx, v, least(255, round_even(sum(n) OVER (PARTITION BY run_id, ty, tx ORDER BY v) * 255.0::DOUBLE / {t * t}, 0)) AS m FROM level),
    place AS (SELECT *, floor(y / {t}.0::DOUBLE - 0.5)::BIGINT AS cy, floor(x / {t}.0::DOUBLE - 0.5)::BIGINT AS cx FROM scene),
    equal AS (SELECT p.run_id, p.y, p.x, round_even(round((a.m * (1 - xa) + b.m * xa) * (1 - ya) + (c.m * (1 - xa) + d.m * xa) * ya, 6), 0)::BIGINT AS v FROM (SELECT *, y / {t}.0::DOUBLE - 0.5 - cy AS ya, x / {t}.0::DOUBLE - 0.5 - cx AS xa FROM place) p
        {corner("a", "cy", "cx")} {corner("b", "cy", "cx + 1")} {corner("c", "cy + 1", "cx")} {corner("d", "cy + 1", "cx + 1")})"""


@query(f"WITH {s.SCENES_SQL}, {_equal_sql(3.0)} SELECT run_id, y, x, v FROM equal")
def clahe(spark, sf_dir):
    return raster.equalize(s.scenes(spark, sf_dir), 3.0)


@query(f"""WITH {s.SCENES_SQL}, {_equal_sql(2.0)}, {_sums_sql('g', 'equal', frames.gaussian_weights(BLOCK), False)}, t AS (SELECT e.run_id, e.y, e.x, CASE WHEN v > round_even(round(s, 6), 0) - 2 THEN 255 ELSE 0 END AS v FROM equal e JOIN g USING (run_id, y, x)),
    share AS (SELECT run_id, avg((v > 0)::INT) AS p FROM t GROUP BY 1) SELECT run_id, y, x, (CASE WHEN p > 0.5 THEN 255 - v ELSE v END)::BIGINT AS v FROM t JOIN share USING (run_id)""")
def adaptive_threshold(spark, sf_dir):
    return raster.adaptive_threshold(s.scenes(spark, sf_dir), BLOCK, 2)


def _pitted(scenes: DataFrame) -> DataFrame:
    """Objects of scenes with pits and dust."""
    dust = (F.col("x") * 7 + F.col("y") * 13 + F.col("run_id")) % 97 == 0
    return scenes.select("run_id", "y", "x", F.when((F.col("v") >= 150) != dust, 255).otherwise(0).cast("long").alias("v"))


_PITTED = "pitted AS (SELECT run_id, y, x, CASE WHEN (v >= 150) != ((x * 7 + y * 13 + run_id) % 97 = 0) THEN 255 ELSE 0 END::BIGINT AS v FROM scene)"


def _extremes_sql(steps: list[tuple[int, str]], source: str) -> str:
    """One table for each (size, max or min): the extreme over an ellipse, by frames of rows and neighbours in columns."""
    out = []
    for k, (size, of) in enumerate(steps):
        half, r = frames.ellipse(size), size // 2
        rows = ", ".join(f"{of}(v) OVER (PARTITION BY run_id, y ORDER BY x ROWS BETWEEN {d} PRECEDING AND {d} FOLLOWING) AS r{d}" for d in sorted(set(half)))
        near = ", ".join(f"lead(r{d}, {j - r}) OVER w" if j >= r else f"lag(r{d}, {r - j}) OVER w" for j, d in enumerate(half))
        out.append(f"e{k} AS (SELECT run_id, y, x, {'greatest' if of == 'max' else 'least'}({near}) AS v FROM (SELECT run_id, y, x, {rows} FROM {source if k == 0 else f'e{k - 1}'}) WINDOW w AS (PARTITION BY run_id, x ORDER BY y))")
    return ", ".join(out)


_CLEANUP = [(3, "min"), (3, "max"), (13, "max"), (13, "max"), (13, "min"), (13, "min")]


@query(f"WITH {s.SCENES_SQL}, {_PITTED}, {_extremes_sql(_CLEANUP, 'pitted')} SELECT run_id, y, x, v FROM e5")
def morphology(spark, sf_dir):
    return raster.cleanup(_pitted(s.scenes(spark, sf_dir)))


# runs of background pixels in a row are linked where they share a column, and reached from those of the corners
@query(f"""WITH RECURSIVE {s.SCENES_SQL}, {_PITTED}, b AS (SELECT run_id, y, x, x - row_number() OVER (PARTITION BY run_id, y ORDER BY x) AS g FROM pitted WHERE v = 0),
    seg AS (SELECT run_id, y, g, min(x) AS x0, max(x) AS x1 FROM b GROUP BY 1, 2, 3), link AS (SELECT a.run_id, a.y, a.g, c.y AS y2, c.g AS g2 FROM seg a JOIN seg c ON a.run_id = c.run_id AND abs(a.y - c.y) = 1 AND a.x0 <= c.x1 AND c.x0 <= a.x1),
    reach AS (SELECT run_id, y, g FROM seg WHERE y IN (0, {LAST}) AND (x0 = 0 OR x1 = {LAST}) UNION SELECT l.run_id, l.y2, l.g2 FROM reach r JOIN link l ON r.run_id = l.run_id AND r.y = l.y AND r.g = l.g),
    hole AS (SELECT b.run_id, b.y, b.x FROM b LEFT JOIN reach r ON b.run_id = r.run_id AND b.y = r.y AND b.g = r.g WHERE r.g IS NULL)
    SELECT p.run_id, p.y, p.x, CASE WHEN h.x IS NULL THEN v ELSE 255 END::BIGINT AS v FROM pitted p LEFT JOIN hole h ON p.run_id = h.run_id AND p.y = h.y AND p.x = h.x""")
def hole_fill(spark, sf_dir):
    return raster.fill_holes(_pitted(s.scenes(spark, sf_dir))).withColumn("v", F.col("v").cast("long"))


def _crop(scenes: DataFrame) -> DataFrame:
    """Images that are not square."""
    return scenes.where("y < 48 AND x < 80")


# a quarter to the left: columns become rows from the last one on
@query(f"""WITH {s.SCENES_SQL}, a AS (SELECT run_id, y, x, v FROM scene WHERE y < 48 AND x < 80), q1 AS (SELECT run_id, 79 - x AS y, y AS x, v FROM a), q2 AS (SELECT run_id, 47 - x AS y, y AS x, v FROM q1), q3 AS (SELECT run_id, 79 - x AS y, y AS x, v FROM q2)
    SELECT run_id, 0 AS view, y::INT AS y, x::INT AS x, v FROM a UNION ALL SELECT run_id, 1, y, x, v FROM q1 UNION ALL SELECT run_id, 2, y, x, v FROM q2 UNION ALL SELECT run_id, 3, y, x, v FROM q3
    UNION ALL SELECT run_id, 4, 47 - y, x, v FROM a UNION ALL SELECT run_id, 5, y, 79 - x, v FROM a UNION ALL SELECT run_id, 6, 79 - y, x, v FROM q1 UNION ALL SELECT run_id, 7, 47 - y, x, v FROM q2 UNION ALL SELECT run_id, 8, 79 - y, x, v FROM q3""")
def nine_views(spark, sf_dir):
    px = _crop(s.scenes(spark, sf_dir))
    return raster.test_time_views(px, frames.sizes(px))


#: Least and greatest number of pixels of an object.
_AREAS = (50, s.SCENE * s.SCENE // 10)


def _objects(spark, sf_dir) -> DataFrame:
    """Runs of pixels of scenes' objects, those that touch parted."""
    px = s.scenes(spark, sf_dir)
    objects = px.select("run_id", "y", "x", F.when(F.col("v") >= 150, 255).otherwise(0).alias("v"))
    return links.cut(raster.object_runs(basins.watershed_lines(objects)))


@query()
def watershed_segments(spark, sf_dir):
    return raster.areas_of_runs(_objects(spark, sf_dir), *_AREAS).drop("_was")


@query()
def contour_measurements(spark, sf_dir):
    runs = _objects(spark, sf_dir)
    new = raster.areas_of_runs(runs, *_AREAS).select("run_id", F.col("label").alias("_new"), F.col("_was").alias("label"))
    kept = runs.join(new.hint("merge"), ["run_id", "label"]).withColumn("label", F.col("_new"))
    made = geometry.measure(raster.contours_of_runs(kept))
    return rounded(made, *(c for c, kind in made.dtypes if kind == "double"))


#: Side of the reduced image, attempts and rounds of the clustering queries.
SMALL, ATTEMPTS, ROUNDS = 96, 4, 10


def _coloured(spark, sf_dir) -> DataFrame:
    """Scenes as colour images: objects in warm colours on a bluish ground."""
    warm = F.when(F.col("v") >= 150, 60).otherwise(-30)
    return s.scenes(spark, sf_dir).select("run_id", "y", "x", (F.col("v") * 4 / 5).cast("long").alias("b"), "v", warm.alias("w")).select(
        "run_id", "y", "x", "b", (F.col("v") * 9 / 10).cast("long").alias("g"), F.greatest(F.lit(0), F.least(F.lit(255), F.col("v") + F.col("w"))).cast("long").alias("r"))


def _hsv_sql(source: str) -> str:
    return f"""SELECT run_id, y, x, CASE WHEN h < 0 THEN h + 180 ELSE h END AS c0, CASE WHEN m = 0 THEN 0 ELSE floor(255.0::DOUBLE * d / m + 0.5)::BIGINT END AS c1, m AS c2 FROM (SELECT *, floor(CASE WHEN d = 0 THEN 0 WHEN m = r THEN 30.0::DOUBLE * (g - b) / d
        WHEN m = g THEN 60 + 30.0::DOUBLE * (b - r) / d ELSE 120 + 30.0::DOUBLE * (r - g) / d END + 0.5)::BIGINT AS h FROM (SELECT *, greatest(b, g, r) AS m, greatest(b, g, r) - least(b, g, r) AS d FROM {source}))"""


def _two_means_sql() -> str:
    """Unrolled rounds: centres of every scene and attempt."""
    far = lambda k: " + ".join(f"(c{j} - {k}{j}) * (c{j} - {k}{j})" for j in range(3))
    b_near = f"({far('b')} < {far('a')})"
    sums = ", ".join(f"sum(CASE WHEN {'' if k == 'b' else 'NOT '}{b_near} THEN {x} ELSE 0 END)::BIGINT AS {k}{name}" for k in "ab" for name, x in (("n", "n"), ("q", "n * (c0 * c0 + c1 * c1 + c2 * c2)"), *((f"s{j}", f"n * c{j}") for j in range(3))))
    keys = "run_id, attempt, a0, a1, a2, b0, b1, b2, done"
    new = ", ".join(f"CASE WHEN NOT done AND {k}n > 0 THEN {k}s{j}::DOUBLE / {k}n ELSE {k}{j} END AS n{k}{j}" for k in "ab" for j in range(3))
    shift = lambda k: " + ".join(f"(n{k}{j} - {k}{j}) * (n{k}{j} - {k}{j})" for j in range(3))
    start = ", ".join(f"arg_{'min' if k == 'a' else 'max'}(c{j}, h)::DOUBLE AS {k}{j}" for k in "ab" for j in range(3))
    out = [f"r0 AS MATERIALIZED (SELECT run_id, attempt, {start}, false AS done FROM (SELECT *, md5(concat_ws(',', 1, attempt, c0, c1, c2)) AS h FROM (SELECT *, unnest(range({ATTEMPTS})) AS attempt FROM colour)) GROUP BY 1, 2)"]
    for k in range(ROUNDS):
        out.append(f"""r{k + 1} AS MATERIALIZED (SELECT run_id, attempt, {", ".join(f"n{c}{j} AS {c}{j}" for c in "ab" for j in range(3))}, done OR greatest({shift("a")}, {shift("b")}) <= 1 AS done
            FROM (SELECT *, {new} FROM (SELECT {keys}, {sums} FROM colour JOIN r{k} USING (run_id) GROUP BY ALL)))""")
    spread = lambda k: f"({k}q - 2 * ({k}0 * {k}s0 + {k}1 * {k}s1 + {k}2 * {k}s2) + {k}n * ({k}0 * {k}0 + {k}1 * {k}1 + {k}2 * {k}2))"
    out.append(f"""best AS MATERIALIZED (SELECT run_id, a0, a1, a2, b0, b1, b2 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round({spread("a")} + {spread("b")}, 3), attempt) AS k
        FROM (SELECT {keys}, {sums} FROM colour JOIN r{ROUNDS} USING (run_id) GROUP BY ALL)) WHERE k = 1)""")
    return ", ".join(out)


_COLOURED = "coloured AS (SELECT run_id, y, x, (v * 4 // 5)::BIGINT AS b, (v * 9 // 10)::BIGINT AS g, greatest(0, least(255, v + CASE WHEN v >= 150 THEN 60 ELSE -30 END))::BIGINT AS r FROM scene)"
_SMALL = f"""little AS (SELECT run_id, y * {SMALL} // {s.SCENE} AS y, x * {SMALL} // {s.SCENE} AS x, {", ".join(f"(2 * sum({c}) + count(*))::BIGINT // (2 * count(*)) AS {c}" for c in "bgr")} FROM coloured GROUP BY 1, 2, 3),
    small AS MATERIALIZED ({_hsv_sql("little")}), colour AS MATERIALIZED (SELECT run_id, c0, c1, c2, count(*) AS n FROM small GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {s.SCENES_SQL}, {_COLOURED}, {_SMALL}, {_two_means_sql()} SELECT run_id, {', '.join(f'round({k}{j}, 6) AS {k}{j}' for k in 'ab' for j in range(3))} FROM best")
def colour_centres(spark, sf_dir):
    """The two colour centres of each scene, of the best of several attempts."""
    made = colours.two_means(colours.in_hsv(colours.reduced(_coloured(spark, sf_dir), SMALL)), ATTEMPTS, ROUNDS)
    return rounded(made, *colours.CENTRES, places=6)


_FAR = {k: " + ".join(f"(c{j} - {k}{j}) * (c{j} - {k}{j})" for j in range(3)) for k in "ab"}


@query(f"""WITH {s.SCENES_SQL}, {_COLOURED}, {_SMALL}, {_two_means_sql()}, vote AS (SELECT run_id, sum(CASE WHEN {_FAR["b"]} < {_FAR["a"]} THEN e ELSE 0 END) > sum(CASE WHEN {_FAR["b"]} < {_FAR["a"]} THEN 0 ELSE e END) AS first
        FROM (SELECT *, (y = 0)::INT + (x = 0)::INT + (y = {SMALL - 1})::INT + (x = {SMALL - 1})::INT AS e FROM small) JOIN best USING (run_id) GROUP BY 1),
    far AS (SELECT run_id, y, x, a2, b2, {_FAR["a"]} AS da, {_FAR["b"]} AS db FROM ({_hsv_sql("coloured")}) JOIN best USING (run_id)), cnt AS (SELECT run_id, count(*) AS n, count(*) FILTER (da < db) AS na, count(*) FILTER (db < da) AS nb FROM far GROUP BY 1),
    pick AS (SELECT run_id, CASE WHEN (CASE WHEN first THEN na ELSE nb END) = 0 OR (CASE WHEN first THEN na ELSE nb END) > 0.9::DOUBLE * n THEN NULL ELSE first END AS first FROM cnt JOIN vote USING (run_id))
    SELECT run_id, y, x, CASE WHEN (CASE WHEN coalesce(first, a2 > b2) THEN da < db ELSE db < da END) THEN 255 ELSE 0 END::BIGINT AS v FROM far JOIN pick USING (run_id)""")
def kmeans_foreground(spark, sf_dir):
    return colours.foreground(_coloured(spark, sf_dir), SMALL, ATTEMPTS)


#: Side and overlap of the tiles of the query, and the origins that they have in a scene.
TILE, OVERLAP = 128, 32
_ORIGINS = sorted({min(k, s.SCENE - TILE) for k in range(0, s.SCENE, TILE - OVERLAP)})


def _red(image):
    """A stand-in for a model: what is bright in red; it fails on tiles whose first pixel's blue is a multiple of three."""
    if image[0, 0, 0] % 3 == 0:
        raise ValueError("first pixel")
    return (image[:, :, 2] > 170).astype("int64")


_TILES = f"""WITH {s.SCENES_SQL}, {_COLOURED}, o AS (SELECT unnest({_ORIGINS}) AS o), tile AS (SELECT run_id, y AS ty, x AS tx, b % 3 = 0 AS bad FROM coloured WHERE y IN (SELECT o FROM o) AND x IN (SELECT o FROM o))"""


@query(f"{_TILES} SELECT c.run_id, c.y, c.x, max(CASE WHEN r > 170 AND NOT bad THEN 255 ELSE 0 END)::BIGINT AS v FROM coloured c JOIN tile t ON c.run_id = t.run_id AND c.y BETWEEN ty AND ty + {TILE - 1} AND c.x BETWEEN tx AND tx + {TILE - 1} GROUP BY 1, 2, 3")
def model_tiles(spark, sf_dir):
    """The mask of a model over overlapping tiles, some of which fail."""
    return strategies.tile_mask(_coloured(spark, sf_dir), lambda: _red, TILE, OVERLAP)[0]


@query(f"{_TILES} SELECT run_id, ty::INT AS ty, tx::INT AS tx, 'ValueError: first pixel' AS error FROM tile WHERE bad")
def failed_tiles(spark, sf_dir):
    return strategies.tile_mask(_coloured(spark, sf_dir), lambda: _red, TILE, OVERLAP)[1]
