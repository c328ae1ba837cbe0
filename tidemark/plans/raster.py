"""Queries over rasters: image features, depth quality, wave measures, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import rounded
from tidemark.operators import peaks, tiles
from tidemark.operators import raster as ra
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views_sql import PIX, RGB, with_views


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """Depth maps as whole grey levels."""
    return views.rasters(spark, d).withColumn("px", F.transform("px", lambda v: F.floor(v * 255).cast("double")))


LEV = "v_l AS (SELECT vec_id, y, x, floor(v * 255)::DOUBLE AS v FROM v_pix)"


def neighbours(name: str, source: str, radius: int, n: int, border: str = "mirror") -> str:
    """CTE ``name(vec_id, y, x, dy, dx, v)``: the value at every offset, borders folded back."""
    def fold(k: str) -> str:
        low, high = (f"-({k})", f"{2 * n - 2} - ({k})") if border == "mirror" else (f"-({k}) - 1", f"{2 * n - 1} - ({k})")
        return f"CASE WHEN {k} < 0 THEN {low} WHEN {k} > {n - 1} THEN {high} ELSE {k} END"
    return f"""{name} AS (SELECT a.vec_id, a.y, a.x, dy, dx, b.v FROM {source} a
  CROSS JOIN (SELECT unnest(range({-radius}, {radius + 1})) AS dy) CROSS JOIN (SELECT unnest(range({-radius}, {radius + 1})) AS dx)
  JOIN {source} b ON b.vec_id = a.vec_id AND b.y = {fold('a.y + dy')} AND b.x = {fold('a.x + dx')})"""


LAPLACE = """v_lap AS (SELECT vec_id, y, x, sum(CASE WHEN dy = 0 AND dx = 0 THEN -4 * v WHEN abs(dy) + abs(dx) = 1 THEN v ELSE 0 END) AS l
  FROM v_nb GROUP BY ALL)"""
SOBEL = """v_sob AS (SELECT vec_id, y, x, sqrt(pow(sum(v * dx * (2 - abs(dy))), 2) + pow(sum(v * dy * (2 - abs(dx))), 2)) AS m
  FROM v_nb GROUP BY ALL)"""


@query("rast_color", with_views(RGB) + """, c AS (SELECT vec_id, """ + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, max({c}) - min({c}) AS {c}_range" for c in "rgb") + """,
    avg(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)) AS grey_mean FROM v_rgb GROUP BY vec_id),
  m AS (SELECT vec_id, avg(t.v) AS mm, stddev_pop(t.v) AS ms FROM c, LATERAL (VALUES (r_mean), (g_mean), (b_mean)) AS t(v) GROUP BY vec_id)
  SELECT vec_id, """ + ", ".join(f"round({c}_{k}, 6) AS {c}_{k}" for c in "rgb" for k in ("mean", "std", "range")) + """,
    round(grey_mean, 6) AS grey_mean, round(1 - ms / mm, 6) AS colour_balance FROM c JOIN m USING (vec_id)""")
def rast_color(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.colour_measures(views.rgb_images(spark, d)).select(
        "vec_id", *[f"{c}_{k}" for c in "rgb" for k in ("mean", "std", "range")], "grey_mean", "colour_balance"))


@query("rast_contrast", with_views(PIX, LEV) + """SELECT vec_id, round(avg(v), 6) AS brightness, round(stddev_pop(v), 6) AS brightness_std,
  round(stddev_pop(v) / avg(v), 6) AS rms_ratio, round(stddev_pop(v) / 255, 6) AS rms_contrast,
  round((max(v) - min(v)) / (max(v) + min(v) + 0.00000001::DOUBLE), 6) AS michelson, round((max(v) - min(v)) / 255, 6) AS dynamic_range
  FROM v_l GROUP BY vec_id""")
def rast_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.grey_measures(_levels(spark, d)).drop("h", "w", "dark_coverage"))


@query("rast_entropy", with_views(PIX, LEV) + """, h AS (SELECT vec_id, v, count(*) AS n FROM v_l GROUP BY 1, 2),
  k AS (SELECT vec_id, b, count(v) AS n FROM (SELECT DISTINCT vec_id FROM v_l) i CROSS JOIN (SELECT unnest(range(0, 32)) AS b)
    LEFT JOIN v_l USING (vec_id) WHERE floor(v / 8) = b GROUP BY 1, 2),
  m AS (SELECT vec_id, 2::DOUBLE AS hist_mean, sqrt(sum(n * n) / 32::DOUBLE - 4) AS hist_std FROM k GROUP BY vec_id)
  SELECT vec_id, round(-sum(n / 64::DOUBLE * log2(n / 64::DOUBLE + 0.0000000001::DOUBLE)), 6) AS entropy,
    arg_max(v, n * 1000 - v) AS dominant_level, any_value(hist_mean) AS hist_mean, round(any_value(hist_std), 6) AS hist_std
  FROM h JOIN m USING (vec_id) GROUP BY vec_id""")
def rast_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.image_measures(_levels(spark, d)).select(
        "vec_id", "entropy", "dominant_level", "hist_mean", "hist_std"))


@query("rast_laplacian", with_views(PIX, LEV, neighbours("v_nb", "v_l", 1, 8), LAPLACE) + """, s AS (SELECT vec_id,
    sum(l * l) / 64 - (sum(l) / 64) * (sum(l) / 64) AS variance FROM v_lap GROUP BY vec_id)
  SELECT vec_id, variance, least(1, variance / 1000) AS sharpness_1k, variance / 10000 AS sharpness_10k FROM s""")
def rast_laplacian(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("laplacian_variance")
    return ra.neighbour_measures(_levels(spark, d)).select(
        "vec_id", v.alias("variance"), F.least(F.lit(1.0), v / 1000.0).alias("sharpness_1k"),
        (v / 10000.0).alias("sharpness_10k"))


@query("rast_sobel", with_views(PIX, LEV, neighbours("v_nb", "v_l", 1, 8), SOBEL) +
       "SELECT vec_id, round(avg(m), 6) AS mean_edge, round(max(m), 6) AS max_edge FROM v_sob GROUP BY vec_id")
def rast_sobel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.neighbour_measures(_levels(spark, d)).select(
        "vec_id", F.col("edge_mean").alias("mean_edge"), F.col("edge_max").alias("max_edge")))


FEATURE_SQL = """v_gr AS (SELECT vec_id, y, x, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE) AS v FROM v_rgb)""" \
    + ",\n" + neighbours("v_nb", "v_gr", 1, 8) + ",\n" + LAPLACE + ",\n" + SOBEL + """,
v_sat AS (SELECT vec_id, avg(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE floor((greatest(r, g, b) - least(r, g, b)) * 255 / greatest(r, g, b) + 0.5::DOUBLE) END) AS s
  FROM v_rgb GROUP BY 1),
v_hb AS (SELECT vec_id, t.c, floor(t.v / 8) AS bin, count(*) AS n FROM v_rgb, LATERAL (VALUES ('b', b), ('g', g), ('r', r)) AS t(c, v) GROUP BY 1, 2, 3),
v_hs AS (SELECT vec_id, c, sqrt(sum(n * n) / 32::DOUBLE - 4) AS sd FROM v_hb GROUP BY 1, 2),
v_fv AS (SELECT g.vec_id, avg(g.v) AS brightness, stddev_pop(g.v) AS contrast, any_value(s) AS saturation, var_pop(l) AS sharpness, avg(m) AS texture,
  2::DOUBLE AS hist_b_mean, any_value(hb.sd) AS hist_b_std, 2::DOUBLE AS hist_g_mean, any_value(hg.sd) AS hist_g_std, 2::DOUBLE AS hist_r_mean,
  any_value(hr.sd) AS hist_r_std FROM v_gr g JOIN v_lap USING (vec_id, y, x) JOIN v_sob USING (vec_id, y, x) JOIN v_sat USING (vec_id)
  JOIN v_hs hb ON hb.vec_id = g.vec_id AND hb.c = 'b' JOIN v_hs hg ON hg.vec_id = g.vec_id AND hg.c = 'g' JOIN v_hs hr ON hr.vec_id = g.vec_id AND hr.c = 'r'
  GROUP BY g.vec_id)"""
FEATURE_COLUMNS = ", ".join(f"round({c}, 9) AS {c}" for c in ra.FEATURES)


@query("feature_vector", with_views(RGB, FEATURE_SQL) + "SELECT vec_id, " + FEATURE_COLUMNS.replace(", 9)", ", 6)").replace(
    "round(sharpness, 6)", "round(sharpness / 3, 6)") + " FROM v_fv")
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    out = ra.feature_vector(views.rgb_images(spark, d))
    return rounded(out.withColumn("sharpness", F.col("sharpness") / 3).select("vec_id", *ra.FEATURES))


HSV = """v_hsv0 AS (SELECT *, greatest(r, g, b) AS vv, greatest(r, g, b) - least(r, g, b) AS df FROM v_rgb),
v_hsv1 AS (SELECT vec_id, y, x, vv, CASE WHEN vv = 0 THEN 0 ELSE floor(df * 255 / vv + 0.5::DOUBLE) END AS s, CASE WHEN df = 0 THEN 0 ELSE
  floor((CASE WHEN vv = r THEN g - b WHEN vv = g THEN b - r + 2 * df ELSE r - g + 4 * df END) * 30 / df + 0.5::DOUBLE) END AS h FROM v_hsv0),
v_hsv AS (SELECT vec_id, y, x, vv, s, CASE WHEN h < 0 THEN h + 180 ELSE h END AS h FROM v_hsv1)"""


@query("rast_water", with_views(RGB, HSV) + """SELECT vec_id, round(avg(s) / 255, 6) AS saturation, round(var_pop(h) / 32400, 6) AS hue_variance,
  round(count_if(h BETWEEN 90 AND 130 AND s >= 50 AND vv >= 50) / count(*)::DOUBLE, 6) AS water_coverage FROM v_hsv GROUP BY vec_id""")
def rast_water(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.colour_measures(views.rgb_images(spark, d)).select("vec_id", "saturation", "hue_variance", "water_coverage"))


@query("rast_blue", with_views(RGB) + """SELECT vec_id, round(count_if(b > r AND b > g) / count(*)::DOUBLE, 6) AS blue_coverage,
  round(count_if(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE) < 128) / count(*)::DOUBLE, 6) AS dark_coverage
  FROM v_rgb WHERE y >= 2 GROUP BY vec_id""")
def rast_blue(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.colour_measures(views.rgb_images(spark, d)).select("vec_id", "blue_coverage", "dark_coverage"))


NOISE = """v_hp AS (SELECT vec_id, y, x, greatest(0, least(255, sum(CASE WHEN dy = 0 AND dx = 0 THEN 8 * v ELSE -v END))) AS r
  FROM v_nb GROUP BY ALL)"""


@query("rast_noise", with_views(PIX, LEV, neighbours("v_nb", "v_l", 1, 8), NOISE, LAPLACE) + """, a AS (SELECT vec_id, stddev_pop(r) / 255 AS n FROM v_hp GROUP BY 1),
  b AS (SELECT vec_id, var_pop(l) / 65025 AS m FROM v_lap GROUP BY 1)
  SELECT vec_id, round(least(1, n), 6) AS noise_level, round(m, 6) AS laplacian_noise FROM a JOIN b USING (vec_id)""")
def rast_noise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.neighbour_measures(_levels(spark, d)).select("vec_id", "noise_level", "laplacian_noise"))


@query("image_score", with_views(PIX, LEV, neighbours("v_nb", "v_l", 1, 8), NOISE, LAPLACE) + """,
  a AS (SELECT vec_id, avg(v) AS br, stddev_pop(v) / 255 AS c, (max(v) - min(v)) / 255 AS dr,
    count_if(y >= 2 AND v < 128) / count_if(y >= 2)::DOUBLE AS o FROM v_l GROUP BY 1),
  b AS (SELECT vec_id, var_pop(l) AS s FROM v_lap GROUP BY 1), n AS (SELECT vec_id, least(1, stddev_pop(r) / 255) AS n FROM v_hp GROUP BY 1)
  SELECT vec_id, round(greatest(0, least(1, 0.3::DOUBLE * c + 0.3::DOUBLE * least(1, s / 1000) + 0.3::DOUBLE * o + 0.1::DOUBLE * (1 - n))), 6) AS strict_score,
    round(greatest(0, least(1, 0.3::DOUBLE * least(c * 2, 1) + 0.3::DOUBLE * least(1, s / 10000) + 0.2::DOUBLE * dr
      + 0.2::DOUBLE * greatest(0, 1 - abs(br - 127.5::DOUBLE) / 127.5::DOUBLE))), 6) AS validator_score,
    round((CASE WHEN br / 255 BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE THEN 1 ELSE 0.5::DOUBLE END + CASE WHEN c > 0.1::DOUBLE THEN 1 ELSE 0.5::DOUBLE END
      + CASE WHEN s > 100 THEN 1 ELSE 0.5::DOUBLE END) / 3, 6) AS flag_score FROM a JOIN b USING (vec_id) JOIN n USING (vec_id)""")
def image_score(spark: SparkSession, d: str) -> DataFrame:
    measured = ra.level_measures(_levels(spark, d))
    scores = ra.image_scores(*map(F.col, ("rms_contrast", "laplacian_variance", "dark_coverage", "noise_level", "dynamic_range", "brightness")))
    return rounded(measured.select("vec_id", *[e.alias(n) for n, e in scores.items()]))


@query("rast_corrupt", """SELECT vec_id, max(CASE WHEN embedding[i] < -0.1::DOUBLE OR embedding[i] > 1.1::DOUBLE THEN 1 ELSE 0 END) = 1 AS is_corrupt
  FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY vec_id""")
def rast_corrupt(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.tables import table
    df = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("px"))
    return df.select("vec_id", ra.is_corrupt(F.col("px")).alias("is_corrupt"))


@query("rast_norm", with_views(PIX) + """SELECT vec_id, round(min(v), 6) AS low, round(max(v), 6) AS high, round(sum(v * (y * 8 + x + 1)), 6) AS weighted
  FROM v_pix GROUP BY vec_id""")
def rast_norm(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.tables import table
    df = table(spark, d, "embeddings").select(
        "vec_id", ra.normalise(F.col("embedding").cast("array<double>")).alias("px"))
    weighted = F.aggregate(F.transform("px", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(df.select("vec_id", F.array_min("px").alias("low"), F.array_max("px").alias("high"),
                             weighted.alias("weighted")))


GRADIENT = """v_g AS (SELECT a.vec_id, a.y, a.x, (r.v - l.v) / (r.x - l.x) AS gx, (d.v - u.v) / (d.y - u.y) AS gy FROM {src} a
  JOIN {src} l ON l.vec_id = a.vec_id AND l.y = a.y AND l.x = greatest(a.x - 1, 0) JOIN {src} r ON r.vec_id = a.vec_id AND r.y = a.y AND r.x = least(a.x + 1, 7)
  JOIN {src} u ON u.vec_id = a.vec_id AND u.x = a.x AND u.y = greatest(a.y - 1, 0) JOIN {src} d ON d.vec_id = a.vec_id AND d.x = a.x AND d.y = least(a.y + 1, 7)),
v_m AS (SELECT *, sqrt(gx * gx + gy * gy) AS m FROM v_g)"""
BOXES = neighbours("v_n3", "v_pix", 3, 8) + """,
v_box AS (SELECT vec_id, y, x, avg(CASE WHEN abs(dy) <= 1 AND abs(dx) <= 1 THEN v END) AS m3, avg(CASE WHEN abs(dy) <= 2 AND abs(dx) <= 2 THEN v END) AS m5,
  avg(CASE WHEN abs(dy) <= 2 AND abs(dx) <= 2 THEN v * v END) AS q5, avg(v) AS m7 FROM v_n3 GROUP BY ALL)"""


@query("depth_quality", with_views(PIX, BOXES, neighbours("v_nb", "v_pix", 1, 8), SOBEL, GRADIENT.format(src="v_pix")) + """,
  a AS (SELECT vec_id, stddev_pop(v) AS sd, avg(v) AS mn, max(v) - min(v) AS rg, stddev_pop(CASE WHEN y < 2 THEN v END) AS far,
    stddev_pop(CASE WHEN y >= 5 THEN v END) AS near FROM v_pix GROUP BY 1),
  t AS (SELECT vec_id, (avg(abs(v - m3)) + avg(abs(v - m5)) + avg(abs(v - m7))) / 3 * 10 AS tx, avg(sqrt(greatest(0, q5 - m5 * m5))) AS lt
    FROM v_pix JOIN v_box USING (vec_id, y, x) GROUP BY 1),
  s AS (SELECT vec_id, avg(m) AS es FROM v_sob GROUP BY 1),
  p AS (SELECT vec_id, quantile_cont(m, 0.95) AS p95 FROM v_m GROUP BY 1),
  c AS (SELECT vec_id, 1 - count_if(m > p95) / 64::DOUBLE AS cons FROM v_m JOIN p USING (vec_id) GROUP BY 1),
  bins AS (SELECT vec_id, least(floor(v * 50), 49) AS bin, count(*) AS n FROM v_pix GROUP BY 1, 2),
  dom AS (SELECT vec_id, arg_max(bin, n * 1000 - bin) AS bin FROM bins GROUP BY 1),
  w AS (SELECT vec_id, least(1, 4 * stddev_pop(abs(v - (bin / 50 + (bin + 1) / 50) / 2))) AS wc FROM v_pix JOIN dom USING (vec_id) GROUP BY 1)
  SELECT vec_id, round(least(1, (sd * 2 + rg) / 2), 6) AS quality_score, round(least(1, tx), 6) AS texture_capture, round(least(1, lt), 6) AS local_texture,
    round(least(1, 2 * CASE WHEN near > 0 THEN far / near ELSE far END), 6) AS far_field, round(cons, 6) AS consistency, round(wc, 6) AS wave_contrast,
    CASE WHEN mn < 0 OR mn > 1 THEN 0 WHEN sd < 0.01::DOUBLE OR sd > 0.5::DOUBLE THEN 0.5::DOUBLE ELSE 1 END AS validity,
    round(greatest(0, least(1, 0.25::DOUBLE * least(1, es) + 0.2::DOUBLE * least(1, lt) + 0.15::DOUBLE * least(1, 2 * far) + 0.15::DOUBLE * sd
      + 0.15::DOUBLE * cons + 0.1::DOUBLE * CASE WHEN mn < 0 OR mn > 1 THEN 0 WHEN sd < 0.01::DOUBLE OR sd > 0.5::DOUBLE THEN 0.5::DOUBLE ELSE 1 END)), 6) AS overall
  FROM a JOIN t USING (vec_id) JOIN s USING (vec_id) JOIN c USING (vec_id) JOIN w USING (vec_id)""")
def depth_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.depth_quality(views.rasters(spark, d)).select(
        "vec_id", "quality_score", "texture_capture", "local_texture", "far_field", "consistency", "wave_contrast",
        "validity", "overall"))


@query("edge_corr", with_views(PIX, LEV, """v_img8 AS (SELECT vec_id, y, x, 255 - v * (1 + y) / 8 AS v FROM v_l)""",
       neighbours("v_nb", "v_l", 1, 8), SOBEL, neighbours("v_nbi", "v_img8", 1, 8), SOBEL.replace("v_sob", "v_sobi").replace("v_nb ", "v_nbi "))
       + """SELECT a.vec_id, round(greatest(0, corr(a.m, b.m)), 6) AS edge_preservation, round(abs(corr(p.v, q.v)), 6) AS brightness_depth
  FROM v_sob a JOIN v_sobi b USING (vec_id, y, x) JOIN v_l p USING (vec_id, y, x) JOIN v_img8 q USING (vec_id, y, x) GROUP BY 1""")
def edge_corr(spark: SparkSession, d: str) -> DataFrame:
    image = F.transform("px", lambda v, i: 255 - v * (1 + F.floor(i / 8)) / 8)
    df = _levels(spark, d).withColumn("image", image)
    return rounded(ra.edge_correlation(df, "image", "px").select("vec_id", "edge_preservation", "brightness_depth"))


def gauss_sql() -> str:
    import math
    raw = [math.exp(-0.5 * i * i) for i in range(-4, 5)]
    weight = "CASE {k} " + " ".join(f"WHEN {i - 4} THEN '{v / sum(raw)!r}'::DOUBLE" for i, v in enumerate(raw)) + " END"
    return neighbours("v_n4", "v_pix", 4, 8, "reflect") + f""",
v_sm AS (SELECT vec_id, y, x, sum(v * {weight.format(k='dy')} * {weight.format(k='dx')}) AS v FROM v_n4 GROUP BY ALL)"""


WAVES = gauss_sql() + ",\n" + GRADIENT.format(src="v_sm") + """,
v_p85 AS (SELECT vec_id, quantile_cont(m, 0.85) AS p85 FROM v_m GROUP BY 1),
v_gs AS (SELECT vec_id, avg(m) AS gradient_mean, stddev_pop(m) AS roughness, count_if(m > p85) / 64::DOUBLE AS foam
  FROM v_m JOIN v_p85 USING (vec_id) GROUP BY 1),
v_row AS (SELECT vec_id, x, v FROM v_sm WHERE y = 4),
v_pow AS (SELECT vec_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * x / 8)), 2) + pow(sum(v * sin(2 * pi() * k * x / 8)), 2)) AS p
  FROM v_row, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2),
v_wl AS (SELECT vec_id, 8 / arg_max(k, p)::DOUBLE AS wavelength FROM v_pow GROUP BY 1),
v_pk AS (SELECT a.vec_id, count_if(a.v > l.v AND a.v > r.v)::BIGINT AS wave_count FROM v_row a JOIN v_row l ON l.vec_id = a.vec_id AND l.x = a.x - 1
  JOIN v_row r ON r.vec_id = a.vec_id AND r.x = a.x + 1 GROUP BY 1),
v_rg AS (SELECT vec_id, max(v) - min(v) AS rg FROM v_sm GROUP BY 1),
v_wave AS (SELECT vec_id, wave_count, wavelength, rg / wavelength AS steepness, gradient_mean, roughness, foam
  FROM v_gs JOIN v_wl USING (vec_id) JOIN v_pk USING (vec_id) JOIN v_rg USING (vec_id))"""


@query("rast_gradient", with_views(PIX, WAVES) + """SELECT vec_id, round(gradient_mean, 6) AS gradient_mean, round(roughness, 6) AS roughness,
  round(foam, 6) AS foam, round(steepness, 6) AS steepness FROM v_wave""")
def rast_gradient(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.wave_characteristics(views.rasters(spark, d)).select(
        "vec_id", "gradient_mean", "roughness", "foam", "steepness"))


IQR = """v_q AS (SELECT vec_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v_pix GROUP BY 1),
v_iqr AS (SELECT vec_id, max(v) - min(v) AS rg FROM v_pix JOIN v_q USING (vec_id)
  WHERE v >= q1 - 1.5::DOUBLE * (q3 - q1) AND v <= q3 + 1.5::DOUBLE * (q3 - q1) GROUP BY 1)"""


@query("rast_iqr_range", with_views(PIX, IQR) + "SELECT vec_id, round(rg, 6) AS iqr_range FROM v_iqr")
def rast_iqr_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.wave_characteristics(views.rasters(spark, d)).select("vec_id", "iqr_range"))


@query("rast_wavelength", with_views(PIX, WAVES) + "SELECT vec_id, round(wavelength, 6) AS wavelength FROM v_wave")
def rast_wavelength(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.wave_characteristics(views.rasters(spark, d)).select("vec_id", "wavelength"))


@query("rast_peaks", with_views(PIX, WAVES) + "SELECT vec_id, wave_count FROM v_wave")
def rast_peaks(spark: SparkSession, d: str) -> DataFrame:
    return ra.wave_characteristics(views.rasters(spark, d)).select("vec_id", "wave_count")


OPENED = gauss_sql() + """,
v_s8 AS (SELECT vec_id, y, x, floor(greatest(0, least(1, v)) * 255) AS v FROM v_sm),
v_cross AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS c(dy, dx)),
v_er AS (SELECT a.vec_id, a.y, a.x, min(b.v) AS v FROM v_s8 a, v_cross JOIN v_s8 b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
v_op AS (SELECT a.vec_id, a.y, a.x, max(b.v) AS v FROM v_er a, v_cross JOIN v_er b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
v_top AS (SELECT s.vec_id, s.y, s.x FROM v_s8 s JOIN v_op o USING (vec_id, y, x) WHERE s.v > o.v),
v_reach AS (SELECT vec_id, y, x, y * 8 + x AS first FROM v_top
  UNION SELECT t.vec_id, t.y, t.x, r.first FROM v_reach r JOIN v_top t ON t.vec_id = r.vec_id AND abs(t.y - r.y) <= 1 AND abs(t.x - r.x) <= 1),
v_root AS (SELECT vec_id, y, x, min(first) AS root FROM v_reach GROUP BY 1, 2, 3),
v_reg AS (SELECT vec_id, root, count(*) AS area, avg(y) AS py, avg(x) AS px FROM v_root GROUP BY 1, 2 HAVING count(*) > 2)"""


@query("wave_peaks", with_views(PIX, OPENED).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY root) AS peak,
  area, round(py, 6) AS y, round(px, 6) AS x FROM v_reg""")
def wave_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Centre and area of every wave peak, numbered by first pixel; element and least area fit maps of 8x8 pixels."""
    found = peaks.wave_peaks(views.rasters(spark, d), element=3, least_area=2)
    rows = found.select("vec_id", F.posexplode("peaks").alias("at", "p"))
    return rounded(rows.select("vec_id", (F.col("at") + 1).cast("bigint").alias("peak"), "p.area", "p.y", "p.x"))


@query("tile_measures", with_views(PIX, LEV, neighbours("v_nb", "v_l", 1, 8), LAPLACE, SOBEL, NOISE) + """,
  g AS (SELECT vec_id, avg(v) AS brightness, stddev_pop(v) AS brightness_std FROM v_l GROUP BY 1),
  l AS (SELECT vec_id, sum(l * l) / 64 - (sum(l) / 64) * (sum(l) / 64) AS laplacian_variance FROM v_lap GROUP BY 1),
  s AS (SELECT vec_id, avg(m) AS edge_mean, max(m) AS edge_max FROM v_sob GROUP BY 1),
  n AS (SELECT vec_id, least(1, stddev_pop(r) / 255) AS noise_level FROM v_hp GROUP BY 1)
  SELECT vec_id, 4 AS tiles, round(brightness, 6) AS brightness, round(brightness_std, 6) AS brightness_std, round(laplacian_variance, 6) AS laplacian_variance,
    round(edge_mean, 6) AS edge_mean, round(edge_max, 6) AS edge_max, round(noise_level, 6) AS noise_level
  FROM g JOIN l USING (vec_id) JOIN s USING (vec_id) JOIN n USING (vec_id)""")
def tile_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures of whole maps from tiles of 5x5 pixels and their halos."""
    byte = F.transform("px", lambda v: F.lpad(F.hex(F.floor(v * 255).cast("bigint")), 2, "0"))
    images = views.rasters(spark, d).withColumn("data", F.unhex(F.array_join(byte, "")))
    return rounded(tiles.tiled_measures(images, "vec_id", side=5).drop("laplacian_noise"))


@query("augment_variants", with_views(PIX, """v_fog AS (SELECT vec_id, y, x, v AS o, 'fog' AS variant,
    greatest(0, least(1, v * (1 - m) + 0.9::DOUBLE * m)) AS v FROM (SELECT *, 0.3::DOUBLE + (0.3::DOUBLE * 0.3::DOUBLE - 0.3::DOUBLE) * y / 7 AS m FROM v_pix)),
v_gl AS (SELECT vec_id, y, x, v AS o, 'glare' AS variant, greatest(0, least(1, v + exp(-3 * sqrt(((x - 4) * (x - 4) + (y - 2) * (y - 2))::DOUBLE)
    / (sqrt(128::DOUBLE) / 2)) * 0.4::DOUBLE)) AS v FROM v_pix),
v_li0 AS (SELECT vec_id, y, x, v AS o, v * 1.1::DOUBLE AS v, avg(v * 1.1::DOUBLE) OVER (PARTITION BY vec_id) AS mn FROM v_pix),
v_li AS (SELECT vec_id, y, x, o, 'lighting' AS variant, greatest(0, least(1, (v - mn) * 0.9::DOUBLE + mn)) AS v FROM v_li0),
v_var AS (SELECT vec_id || variant AS vec_id, vec_id AS id, variant, y, x, o, v FROM (SELECT * FROM v_fog UNION ALL SELECT * FROM v_gl UNION ALL SELECT * FROM v_li))""",
       neighbours("v_nb", "v_var", 1, 8), SOBEL, neighbours("v_nbo", "v_pix", 1, 8), SOBEL.replace("v_sob", "v_sobo").replace("v_nb ", "v_nbo ")) + """,
  e1 AS (SELECT vec_id, count_if(m > 0.5::DOUBLE) AS e1 FROM v_sob GROUP BY 1), e0 AS (SELECT vec_id, count_if(m > 0.5::DOUBLE) AS e0 FROM v_sobo GROUP BY 1),
  c AS (SELECT vec_id, id, variant, corr(o, v) AS cr, avg(o) AS mo, avg(v) AS mv FROM v_var GROUP BY 1, 2, 3),
  k AS (SELECT c.*, e0 = 0 OR (e1 >= 0.8::DOUBLE * e0 AND cr >= 0.95::DOUBLE) AS preserved FROM c JOIN e1 USING (vec_id) JOIN e0 ON e0.vec_id = c.id)
  SELECT id AS vec_id, variant, round(cr, 6) AS correlation, preserved, round(CASE WHEN preserved THEN mv ELSE mo END, 6) AS result_mean FROM k""")
def augment_variants(spark: SparkSession, d: str) -> DataFrame:
    out = ra.augment_variants(views.rasters(spark, d))
    return rounded(out.select("vec_id", "variant", "correlation", "preserved", ra.mean(F.col("result")).alias("result_mean")))


@query("rast_equalize", with_views(PIX, LEV) + """, h AS (SELECT vec_id, v, count(*) AS n FROM v_l GROUP BY 1, 2),
  c AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY v) AS cum, first_value(n) OVER (PARTITION BY vec_id ORDER BY v) AS f FROM h),
  m AS (SELECT vec_id, v, round_even((cum - f) * 255 / (64 - f)::DOUBLE, 0) AS nv FROM c),
  e AS (SELECT vec_id, nv / 255 AS v FROM v_l JOIN m USING (vec_id, v)),
  md AS (SELECT vec_id, quantile_cont(v, 0.5) AS md FROM e GROUP BY 1)
  SELECT vec_id, round(avg(v), 6) AS equalised_mean, round(any_value(md), 6) AS equalised_median,
    round(avg(greatest(0, least(1, md + (v - md) * 1.5::DOUBLE))), 6) AS enhanced_mean FROM e JOIN md USING (vec_id) GROUP BY vec_id""")
def rast_equalize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.equalise(_levels(spark, d)).select(
        "vec_id", ra.mean(F.col("px")).alias("equalised_mean"), F.col("median").alias("equalised_median"),
        ra.mean(F.col("enhanced")).alias("enhanced_mean")))


@query("rule_labels", with_views(PIX, WAVES, IQR, neighbours("v_n2", "v_pix", 2, 8, "reflect"), """v_b5 AS (SELECT vec_id, y, x, avg(v) AS v FROM v_n2 GROUP BY ALL)""",
       GRADIENT.format(src="v_b5").replace("v_g AS", "v_gb AS").split(",\nv_m AS")[0], GRADIENT.format(src="v_pix").replace("v_g AS", "v_gp AS").split(",\nv_m AS")[0]) + """,
  d AS (SELECT vec_id, avg(gx) AS g FROM v_gb GROUP BY 1), dp AS (SELECT vec_id, avg(gx) AS gp FROM v_gp GROUP BY 1), rp AS (SELECT vec_id, max(v) - min(v) AS rp FROM v_pix GROUP BY 1),
  w AS (SELECT vec_id, (vec_id % 11) / 10::DOUBLE AS wind FROM embeddings)
  SELECT vec_id, round(greatest(0.5::DOUBLE, least(8, rg * 8.5::DOUBLE + 0.1::DOUBLE)), 6) AS height_meters,
    round(0.95::DOUBLE * CASE WHEN wave_count < 2 THEN 0.9::DOUBLE WHEN wave_count > 10 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN steepness > 0.2::DOUBLE THEN 0.9::DOUBLE ELSE 1 END, 6) AS height_confidence,
    CASE WHEN g > 0.008::DOUBLE THEN 'RIGHT' WHEN g < -0.008::DOUBLE THEN 'LEFT' ELSE 'STRAIGHT' END AS direction,
    round(CASE WHEN abs(g) <= 0.008::DOUBLE THEN 0.85::DOUBLE ELSE least(0.95::DOUBLE, 0.7::DOUBLE + abs(g) * 20) END * CASE WHEN wave_count > 5 THEN 0.9::DOUBLE ELSE 1 END, 6) AS direction_confidence,
    CASE WHEN wind > 0.6::DOUBLE THEN 'SPILLING' WHEN steepness > 0.12::DOUBLE THEN 'PLUNGING' WHEN gradient_mean < 0.05::DOUBLE THEN 'SURGING' ELSE 'PLUNGING' END AS breaking_type,
    round(CASE WHEN wind > 0.6::DOUBLE THEN 0.9::DOUBLE WHEN steepness > 0.12::DOUBLE THEN 0.88::DOUBLE WHEN gradient_mean < 0.05::DOUBLE THEN 0.85::DOUBLE ELSE 0.82::DOUBLE END, 6) AS breaking_confidence,
    round(greatest(0.5::DOUBLE, least(8, rp * 8)), 6) AS fallback_height, CASE WHEN gp > 0.01::DOUBLE THEN 'RIGHT' WHEN gp < -0.01::DOUBLE THEN 'LEFT' ELSE 'STRAIGHT' END AS fallback_direction,
    CASE WHEN wind > 0.6::DOUBLE THEN 'SPILLING' WHEN rp > 0.12::DOUBLE THEN 'PLUNGING' ELSE 'SURGING' END AS fallback_breaking
  FROM v_wave JOIN v_iqr USING (vec_id) JOIN d USING (vec_id) JOIN dp USING (vec_id) JOIN rp USING (vec_id) JOIN w USING (vec_id)""")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    waves = ra.wave_characteristics(views.rasters(spark, d))
    return rounded(ra.rule_labels(waves, (F.col("vec_id") % 11) / 10.0).select(
        "vec_id", "height_meters", "height_confidence", "direction", "direction_confidence", "breaking_type",
        "breaking_confidence", "fallback_height", "fallback_direction", "fallback_breaking"))


@query("pixel_rows", with_views(PIX) + "SELECT vec_id, y, x, round(v, 9) AS v FROM v_pix")
def pixel_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.pixel_rows(views.rasters(spark, d)), 9)


@query("join_rgb_depth", with_views(RGB) + """, i AS (SELECT vec_id, avg(r + g + b) / 3 AS brightness FROM v_rgb GROUP BY 1),
  d AS (SELECT vec_id, avg(v) AS depth_mean FROM v_pix WHERE vec_id % 3 > 0 GROUP BY 1)
  SELECT vec_id, round(brightness, 6) AS brightness, round(depth_mean, 6) AS depth_mean FROM i JOIN d USING (vec_id)""")
def join_rgb_depth(spark: SparkSession, d: str) -> DataFrame:
    rgb = views.rgb_images(spark, d).select("vec_id", (
        (ra.mean(F.col("r")) + ra.mean(F.col("g")) + ra.mean(F.col("b"))) / 3.0).alias("brightness"))
    depth = views.rasters(spark, d).filter(F.col("vec_id") % 3 > 0) \
        .select("vec_id", ra.mean(F.col("px")).alias("depth_mean"))
    return rounded(rgb.join(depth, "vec_id"))
