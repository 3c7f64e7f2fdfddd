"""Queries for per-group standardisation, ranks, samples, splits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.functions import fixed
from understory.functions.exprs import height_class
from understory.operators import order as O, sampling as S
from understory.plans.projections import TEXTURES
from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import hash_sql, r

CELL = ["patch_num", "row", "col"]


def z_sql(b: str, eps: str, clip: bool, flat: str) -> str:
    z = f'("{b}" - avg("{b}") OVER w) / nullif(stddev_pop("{b}") OVER w{eps}, 0)'
    if clip:
        z = f"greatest(-5, least(5, {z}))"
    return r(f'CASE WHEN stddev_pop("{b}") OVER w > 0 THEN {z} ELSE {flat} END') + f' AS "{b}"'


@query("standardize_patch_band", f"SELECT patch_num, row, col, {z_sql('B4', ' + 1e-8', True, '0')}, {z_sql('S1_VV', ' + 1e-8', True, '0')} FROM pixels WINDOW w AS (PARTITION BY patch_num)")
def standardize_patch_band(t):
    return rounded(S.standardize(t.pixels.select(*CELL, "B4", "S1_VV"), ["B4", "S1_VV"]))


@query("standardize_patch_band_plain", f"""SELECT patch_num, row, col, {z_sql('B8', '', False, '"B8"')} FROM pixels WINDOW w AS (PARTITION BY patch_num)""")
def standardize_patch_band_plain(t):
    return rounded(S.standardize(t.pixels.select(*CELL, "B8"), ["B8"], epsilon=0.0, limit=None, zero_when_flat=False))


CLASS = "CAST(" + " + ".join(f"(reference_height >= {int(e)})::INT" for e in fixed.HEIGHT_EDGES) + " AS INT)"


@query("stratified_sample", f"""WITH c AS (SELECT patch_num, row, col, hkey, reference_height, {CLASS} AS class_no FROM pixels),
 q AS (SELECT patch_num, count(*) AS total, greatest(1, 200 // count(DISTINCT class_no)) AS quota FROM c GROUP BY patch_num),
 n AS (SELECT c.*, total, quota, row_number() OVER (PARTITION BY patch_num, class_no ORDER BY hkey, row, col) AS rn FROM c JOIN q USING (patch_num)),
 f AS (SELECT *, row_number() OVER (PARTITION BY patch_num ORDER BY (rn > quota)::INT, hkey, row, col) AS pos FROM n)
 SELECT patch_num, row, col, class_no FROM f WHERE total <= 200 OR rn <= quota OR pos <= 200""")
def stratified_sample(t):
    px = t.pixels.select(*CELL, "hkey", "reference_height")
    return S.stratified_sample(px, "reference_height", 200, "patch_num", "hkey", ["row", "col"]).select(*CELL, "class_no")


@query("capped_sample", "SELECT patch_num, row, col FROM pixels QUALIFY row_number() OVER (PARTITION BY patch_num ORDER BY hkey, row, col) <= 100")
def capped_sample(t):
    return S.capped_sample(t.pixels.select(*CELL, "hkey"), ["patch_num"], 100, "hkey", ["row", "col"]).select(*CELL)


@query("spearman_ranks", f"""SELECT DISTINCT region, reference_height AS value, count(*) OVER (PARTITION BY region, reference_height) AS n,
 {r('rank() OVER (PARTITION BY region ORDER BY reference_height) + (count(*) OVER (PARTITION BY region, reference_height) - 1) / 2.0')} AS avg_rank FROM footprints""")
def spearman_ranks(t):
    return O.average_ranks(t.footprints, ["region"], "reference_height").select(
        "region", F.col("reference_height").alias("value"), "n", "avg_rank")


@query("patch_row_ids", "SELECT patch_num, patch_id, CAST(row_number() OVER (ORDER BY patch_num) - 1 AS BIGINT) AS patch_no FROM patches")
def patch_row_ids(t):
    return t.patches.select("patch_num", "patch_id").join(S.row_positions(t.patches, "patch_num", "patch_no"), "patch_num")


TRAIN = f"({hash_sql('patch_num', seed=42)} < {int(1000003 * 0.8)})"


@query("normalize_groups", f"""WITH p AS (SELECT patch_num, row, col, "B4", "S1_VV", {TRAIN} AS train FROM pixels),
 m AS (SELECT avg("B4") AS m1, stddev_samp("B4") AS s1, avg("S1_VV") AS m2, stddev_samp("S1_VV") AS s2 FROM p WHERE train)
 SELECT patch_num, row, col, train, {r('("B4" - m1) / (CASE WHEN s1 = 0 THEN 1 ELSE s1 END)')} AS "B4", {r('("S1_VV" - m2) / (CASE WHEN s2 = 0 THEN 1 ELSE s2 END)')} AS "S1_VV" FROM p, m""")
def normalize_groups(t):
    rows = t.pixels.select(*CELL, "B4", "S1_VV", S.hash_split(["patch_num"], 0.8).alias("train"))
    return rounded(S.normalize_by_training(rows, ["B4", "S1_VV"], F.col("train")))


def poly(cs, x):
    out = f"({cs[0]}::DOUBLE)"
    for c in cs[1:]:
        out = f"({out} * {x} + ({c}::DOUBLE))"
    return out


def inverse_sql(p: str) -> str:
    q = f"({p} - 0.5::DOUBLE)"
    t0, t1 = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (f"(CASE WHEN {p} < {S._TAIL_AT}::DOUBLE THEN {poly(S._TAIL_TOP, t0)} / {poly(S._TAIL_LOW, t0)} "
            f"WHEN {p} > {1 - S._TAIL_AT}::DOUBLE THEN -({poly(S._TAIL_TOP, t1)} / {poly(S._TAIL_LOW, t1)}) "
            f"ELSE {poly(S._CENTRE_TOP, f'({q} * {q})')} * {q} / {poly(S._CENTRE_LOW, f'({q} * {q})')} END)")


@query("quantile_normal", f"""WITH l AS (SELECT 'rh' AS band, rh AS value FROM pixels WHERE rh IS NOT NULL UNION ALL SELECT 'mean', reference_height FROM pixels),
 k AS (SELECT band, value, count(*) AS n FROM l GROUP BY band, value),
 s AS (SELECT band, value, n, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, (sum(n) OVER (PARTITION BY band ORDER BY value) - n + (n - 1) / 2.0) / greatest(sum(n) OVER (PARTITION BY band) - 1, 1))) AS p FROM k)
 SELECT band, {r('value')} AS value, n, {r(inverse_sql('p'))} AS normal FROM s""")
def quantile_normal(t):
    px = t.pixels.select("rh", F.col("reference_height").alias("mean"))
    return rounded(S.quantile_normal(px, ["rh", "mean"]))


@query("height_bins", f"SELECT fid, {CLASS} AS class_no FROM footprints")
def height_bins(t):
    return t.footprints.select("fid", height_class("reference_height").alias("class_no"))


# ---- set operations and splits -----------------------------------------------------------

@query("patch_split", f"SELECT patch_num, {TRAIN} AS train, {hash_sql('patch_num', seed=7)} < {int(1000003 * 0.7)} AS train_70 FROM patches")
def patch_split(t):
    return t.patches.select("patch_num", S.hash_split(["patch_num"], 0.8).alias("train"),
                            S.hash_split(["patch_num"], 0.7, seed=7).alias("train_70"))


@query("train_test_split_rows", f"SELECT patch_num, row, col, {hash_sql('patch_num', 'row', 'col', seed=42)} < {int(1000003 * 0.8)} AS train FROM pixels")
def train_test_split_rows(t):
    return t.pixels.select(*CELL, S.hash_split(CELL, 0.8).alias("train"))


@query("union_tables", f"""SELECT fid, region, {r('rh')} AS rh, NULL::DOUBLE AS pred FROM footprints UNION ALL SELECT patch_order, region, NULL, {r('pred')} FROM predictions""")
def union_tables(t):
    left = t.footprints.select("fid", "region", "rh")
    right = t.predictions.select(F.col("patch_order").alias("fid"), "region", "pred")
    return rounded(left.unionByName(right, allowMissingColumns=True))


@query("union_collections", "SELECT px, ts, CAST(NULL AS BIGINT) AS event_id FROM observations UNION ALL SELECT px, ts, event_id FROM scenes")
def union_collections(t):
    return t.observations.select("px", "ts", F.lit(None).cast("long").alias("event_id")).unionAll(
        t.scenes.select("px", "ts", "event_id"))


@query("distinct_files", "SELECT path FROM files WHERE path LIKE '%embedding%' UNION SELECT path FROM files WHERE path LIKE '%gedi%reference%.csv'")
def distinct_files(t):
    hits = [t.files.where(F.col("path").like(p)).select("path") for p in ("%embedding%", "%gedi%reference%.csv")]
    return hits[0].union(hits[1]).distinct()


@query("missing_columns", """WITH p AS (SELECT run, list_distinct(list(CASE doc_id % 5 WHEN 0 THEN 'embedding' WHEN 1 THEN 'temporal' WHEN 2 THEN 'rf' WHEN 3 THEN 'mlp' ELSE 'csv' END)) AS present FROM files GROUP BY run)
 SELECT run, array_to_string(list_sort(list_filter(['embedding', 'temporal', 'rf', 'mlp', 'unet'], lambda x: NOT list_contains(present, x))), ',') AS missing FROM p""")
def missing_columns(t):
    # five kinds at most, so the set per run is bounded
    kind = (F.when(F.col("doc_id") % 5 == 0, "embedding").when(F.col("doc_id") % 5 == 1, "temporal")
            .when(F.col("doc_id") % 5 == 2, "rf").when(F.col("doc_id") % 5 == 3, "mlp").otherwise("csv"))
    wanted = F.array(*[F.lit(v) for v in ("embedding", "temporal", "rf", "mlp", "unet")])
    return t.files.groupBy("run").agg(F.collect_set(kind).alias("p")).select(
        "run", F.array_join(F.array_sort(F.array_except(wanted, "p")), ",").alias("missing"))


@query("first_k_files", "SELECT run, path FROM (SELECT DISTINCT run, path FROM files) QUALIFY row_number() OVER (PARTITION BY run ORDER BY path) <= 3")
def first_k_files(t):
    from understory.sources.listing import first_files
    return first_files(t.files.select("run", "path").distinct(), ["run"], 3)


FEATURE_VAR = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, rh - reference_height)) AS v FROM footprints" for c in TEXTURES)


@query("top_features", f"SELECT feature, {r('v')} AS importance FROM ({FEATURE_VAR}) ORDER BY v DESC LIMIT 5")
def top_features(t):
    from understory.operators.metrics import stacked
    long = stacked(t.footprints.withColumn("e", F.col("rh") - F.col("reference_height")), ["e"], TEXTURES, "feature", "v")
    return rounded(long.groupBy("feature").agg(F.abs(F.corr("v", "e")).alias("importance"))
                   .orderBy(F.desc("importance")).limit(5))


@query("band_intersection", "SELECT patch_num, list_has_any(['rh'], CASE WHEN count(rh) > 0 THEN ['rh'] ELSE []::VARCHAR[] END) AS has_rh FROM pixels GROUP BY patch_num")
def band_intersection(t):
    held = F.when(F.count("rh") > 0, F.array(F.lit("rh"))).otherwise(F.array().cast("array<string>"))
    return t.pixels.groupBy("patch_num").agg(
        (F.size(F.array_intersect(F.array(F.lit("rh")), held)) > 0).alias("has_rh"))


