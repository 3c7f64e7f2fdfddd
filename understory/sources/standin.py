"""Stand-in views: the engine's core tables derived from the driver's Parquet tables.

Each view is a projection (or one partial-aggregated grouping) over a whole table, so
filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from understory.functions import fixed
from understory.functions.exprs import sample_hash
from understory.session import parts

# Lines that a task sorts to find the first one of each cell.
TASK_LINES = 1_200_000

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.col("l_quantity").cast("long"))


def _region(key: Column) -> Column:
    codes = [code for code, _, _ in fixed.REGIONS]
    return (F.when(key % 3 == 0, codes[0]).when(key % 3 == 1, codes[1]).otherwise(codes[2]))


class Tables:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def n_lines(self) -> int:
        return self.lineitem.count()  # told by the files' footers

    @cached_property
    def footprints(self) -> DataFrame:
        qty, price = F.col("l_quantity"), F.col("l_extendedprice")
        part, order, supp = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
        disc, tax, line = F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
        return self.lineitem.select(
            _line_id().alias("fid"),
            sample_hash([*LINE_KEYS, qty]).alias("hkey"),
            supp.alias("patch_num"), order.alias("granule_key"),
            (order % 64).cast("int").alias("row"), (part % 64).cast("int").alias("col"),
            _region(supp).alias("region"),
            (F.lit(134.0) + (part % 1000) / 1000.0).alias("longitude"),
            (F.lit(34.0) + (order % 1000) / 1000.0).alias("latitude"),
            F.col("l_shipdate").alias("ts"),
            (qty + (price - 52000.0) / 6000.0).alias("rh"),
            qty.alias("reference_height"),
            F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("quality_flag"),
            F.lit(0).alias("degrade_flag"),
            (1.0 - disc).alias("sensitivity"),
            line.alias("beam"),
            (tax * 100.0 - 4.0).alias("solar_elevation"),
            (1 + order % 3).cast("int").alias("num_detectedmodes"),
            (price / 60.0).alias("elev_lowestmode"), (price / 60.0 - disc * 600.0).alias("srtm"),
            F.when(part % 7 != 0, qty * 0.7 + line * 1.0).alias("ch_potapov2021"),
            (qty * 1.1 - tax * 30.0).alias("ch_lang2022"),
            F.when(part % 11 != 0, qty * 0.8 + disc * 40.0).alias("ch_tolan2024"),
            F.when(supp % 5 != 0, qty * 0.9 + tax * 50.0).alias("ch_pauls2024"),
            disc.alias("mean_asm"), tax.alias("mean_contrast"),
            ((price + (part % 97) * 500.0) / 99991.0).alias("mean_corr"),
            (price / 1000.0 - qty).alias("mean_var"),
            F.when(part % 13 != 0, price / qty / 1013.0).alias("mean_ent"),
            (line * 2.0).alias("median_savg"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Overlapping predictions: several rows per (patch, cell), ordered by ``patch_order``."""
        qty, price = F.col("l_quantity"), F.col("l_extendedprice")
        return self.lineitem.select(
            _region(F.col("l_suppkey")).alias("region"),
            F.col("l_suppkey").alias("patch_num"),
            (F.col("l_orderkey") % 64).cast("int").alias("row"),
            (F.col("l_partkey") % 64).cast("int").alias("col"),
            _line_id().alias("patch_order"),
            F.when(F.col("l_linenumber") != 7, qty + (price - 52000.0) / 6000.0).alias("pred"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        """One row per (patch, row, col): the first line of each cell supplies the bands.

        Lines are dealt by their cell before they are sorted, in parts that hold about as many whatever the table's size;
        sorting each file split first would hold a whole split, and few cells have a second line in it.
        """
        qty, price = F.col("b.l_quantity"), F.col("b.l_extendedprice")
        disc, tax = F.col("b.l_discount"), F.col("b.l_tax")
        order, part, line = F.col("b.l_orderkey"), F.col("b.l_partkey"), F.col("b.l_linenumber")
        lines = self.lineitem.withColumns({
            "patch_num": F.col("l_suppkey"), "row": (F.col("l_orderkey") % 64).cast("int"), "col": (F.col("l_partkey") % 64).cast("int")})
        cell = ["patch_num", "row", "col"]
        cells = lines.repartition(parts(self.spark, self.n_lines, TASK_LINES), *cell).groupBy(*cell).agg(F.min_by(F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                "l_returnflag"), _line_id()).alias("b"))
        return cells.select(
            "patch_num", "row", "col",
            F.format_string("patch%04d", "patch_num").alias("patch_id"),
            _region(F.col("patch_num")).alias("region"),
            sample_hash([order, part, F.col("patch_num"), line, qty]).alias("hkey"),
            (qty * 0.3 - 25.0).alias("S1_VV"), (tax * 100.0 - 31.0).alias("S1_VH"),
            (price / 20.0).alias("B4"), (qty * 150.0).alias("B8"),
            (price / 10.0).alias("ALOS2_HH"), (price / 25.0).alias("ALOS2_HV"),
            (price / 60.0).alias("DEM"), (tax * 500.0).alias("slope"),
            (part % 360).cast("double").alias("aspect"),
            F.when(part % 7 != 0, qty * 0.7 + line * 1.0).alias("ch_potapov2021"),
            (qty * 1.1 - tax * 30.0).alias("ch_lang2022"),
            F.when(part % 11 != 0, qty * 0.8 + disc * 40.0).alias("ch_tolan2024"),
            F.when(F.col("patch_num") % 5 != 0, qty * 0.9 + tax * 50.0).alias("ch_pauls2024"),
            F.when(F.col("b.l_returnflag") != "R", 1.0).otherwise(0.0).alias("forest_mask"),
            F.when((order % 3 == 0) & (F.col("patch_num") % 6 != 1),
                   qty + (price - 52000.0) / 6000.0).alias("rh"),
            qty.alias("reference_height"),
            F.when(line != 7, qty + (price - 52000.0) / 6000.0).alias("pred"),
            (qty * 0.9 + disc * 50.0).alias("pred_b"),
        )

    @cached_property
    def patches(self) -> DataFrame:
        """Patch catalogue rows derived from the pixels: a box of 64 cells of 10 m per patch."""
        order = F.col("patch_num")
        return self.pixels.groupBy("patch_num", "patch_id", "region").agg(
            F.count(F.lit(1)).alias("n_pixels"),
            F.count("rh").alias("n_rh")).select(
            "patch_num", "patch_id", "region", "n_pixels", "n_rh",
            (F.pmod(order, F.lit(10)) * 600.0).alias("min_x"),
            (F.floor(order / 10) * 600.0).alias("min_y"),
            (F.pmod(order, F.lit(10)) * 600.0 + 640.0).alias("max_x"),
            (F.floor(order / 10) * 600.0 + 640.0).alias("max_y"),
            F.when(order % 4 == 0, 196).when(order % 2 == 1, 31).otherwise(30).alias("band_count"),
            (order % 4 == 0).alias("temporal"),
            F.lit("EPSG:32653").alias("crs"), F.lit(10.0).alias("pixel_size"))

    @cached_property
    def reference_cells(self) -> DataFrame:
        """Dense reference grid per region, 64 x 64 cells over one degree, with no-data codes."""
        return self.lineitem.groupBy(
            _region(F.col("l_suppkey")).alias("region"),
            (F.col("l_orderkey") % 64).cast("int").alias("row"),
            (F.col("l_partkey") % 64).cast("int").alias("col"),
        ).agg(F.min_by("l_quantity", _line_id()).alias("v")).select(
            "region", "row", "col",
            F.when((F.col("row") * 64 + F.col("col")) % 17 == 0, -32767.0)
            .otherwise(F.col("v")).alias("value"),
            F.when((F.col("row") + F.col("col")) % 3 != 0, 1).otherwise(0).alias("mask"))

    @cached_property
    def patch_grids(self) -> DataFrame:
        """A grid of 64 x 64 cells for each patch in zone 53, side by side near the zone's edge; every fourth has cells too small
        for ten of 100 m on a side."""
        order = F.col("patch_num")
        return self.lineitem.select(F.col("l_suppkey").alias("patch_num")).distinct().select(
            _region(order).alias("region"), "patch_num", F.lit(32653).alias("code"),
            (F.pmod(order, F.lit(10)) * 1900.0 + 770000.0).alias("left"), (3880000.0 - F.floor(order / 10) * 1900.0).alias("top"),
            F.when(order % 4 == 0, 12.0).otherwise(30.0).alias("res"), F.lit(64).alias("rows"), F.lit(64).alias("cols"))

    @cached_property
    def reference_grids(self) -> DataFrame:
        """The grid of each region's reference cells, in zone 54; three rows, the regions."""
        return self.lineitem.select(_region(F.col("l_suppkey")).alias("region")).distinct().select(
            "region", F.lit(32654).alias("code"), F.lit(220000.0).alias("left"), F.lit(3884000.0).alias("top"),
            F.lit(800.0).alias("res"), F.lit(64).alias("rows"), F.lit(64).alias("cols"))

    @cached_property
    def observations(self) -> DataFrame:
        """Scene observations per pixel over 1995-2001."""
        qty, price = F.col("l_quantity"), F.col("l_extendedprice")
        part, line, order = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey")
        return self.lineitem.select(
            _line_id().alias("obs_id"),
            (F.col("l_suppkey") * 16 + part % 16).alias("px"),
            F.concat_ws("_", F.lit("S2"), order % 500).alias("scene_id"),
            F.col("l_shipdate").alias("ts"),
            F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
            (qty * 0.3 - 25.0).alias("VV"), (F.col("l_tax") * 100.0 - 31.0).alias("VH"),
            (price / 20.0).alias("B4"), (qty * 150.0).alias("B8"),
            F.when(line != 7, qty * 120.0).alias("B8A"),
            F.when(part % 19 != 0, qty * 90.0).alias("B9"),
            (price / 10.0).alias("HH"),
            F.when(line != 6, price / 25.0).alias("HV"),
            (F.col("l_discount") * 1000.0).alias("probability"),
            (F.col("l_tax") * 500.0).alias("cloudy_pct"),
            ((order % 4) * 1024).cast("int").alias("qa60"),
            (line % 4).alias("dw_label"), (line % 4 + 1).alias("fnf4"), (line % 3 + 1).alias("fnf"),
            F.when(part % 16 % 3 == 0, 10).otherwise(40).alias("wc"),
            (qty - 2.0).alias("chm"),
        )

    @cached_property
    def scenes(self) -> DataFrame:
        e = F.col("event_id")
        return self.read("events").select(
            e.alias("event_id"),
            F.concat_ws("_", "event_type", F.date_format("ts", "yyyyMMdd")).alias("scene_id"),
            F.col("event_type").alias("sensor"), "ts", F.col("user_id").alias("px"), "value",
            F.get_json_object("props", "$.k").cast("double").alias("probability"),
            F.when(e % 5 == 0, "EW").otherwise("IW").alias("instrument_mode"),
            F.when(e % 7 == 0, 40).otherwise(10).alias("resolution_meters"),
            F.when(e % 3 == 0, F.array(F.lit("HH"))).otherwise(F.array(F.lit("VV"), F.lit("VH"))).alias("pols"),
        )

    @cached_property
    def granules(self) -> DataFrame:
        """Granule index: one row per order with its footprints' time span and bounds."""
        return self.footprints.groupBy(F.col("granule_key")).agg(
            F.min("ts").alias("time_start"), F.max("ts").alias("time_end"),
            F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
            F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"))

    @cached_property
    def embedding_pixels(self) -> DataFrame:
        v = F.col("vec_id")
        return self.read("embeddings").select(
            "vec_id", F.floor(v / 64).cast("int").alias("patch_num"),
            F.floor((v % 64) / 8).cast("int").alias("row"), (v % 8).cast("int").alias("col"),
            F.col("label").cast("int").alias("label"), "embedding")

    @cached_property
    def embedding_wide(self) -> DataFrame:
        return self.embedding_pixels.select(
            "vec_id", "patch_num", "row", "col", "label",
            *[F.get("embedding", i).cast("double").alias(b)
              for i, b in enumerate(fixed.EMBEDDING_BANDS)])

    @cached_property
    def files(self) -> DataFrame:
        """File listing: one path per document, with region, model and patch in its name."""
        d = F.col("doc_id")
        area = F.concat(F.lit("dchm_"), _region(d))
        patch = F.format_string("%04d", d % 10000)
        name = (F.when(d % 5 == 0, F.concat(area, F.lit("_embedding_bandNum70_scale10_patch"), patch, F.lit(".tif")))
                .when(d % 5 == 1, F.concat(area, F.lit("_temporal_bandNum196_scale10_patch"), patch, F.lit(".tif")))
                .when(d % 5 == 2, F.concat(F.lit("rf_"), area, F.lit("_patch"), patch, F.lit("_prediction.tif")))
                .when(d % 5 == 3, F.concat(F.lit("mlp_"), area, F.lit("_run"), F.col("lang"), F.lit("_prediction.tif")))
                .otherwise(F.concat(F.lit("gedi_embedding_mosaic_b64_"), F.col("lang"), F.lit("_with_reference.csv"))))
        return self.read("documents").select(
            d.alias("doc_id"), F.col("source").alias("run"), "lang",
            F.concat_ws("/", F.lit("outputs"), F.col("source"), name).alias("path"),
            F.col("n_chars").alias("size"))

    @cached_property
    def regions(self) -> DataFrame:
        """Three fixed rows, so it is always safe to broadcast."""
        return self.spark.createDataFrame(
            fixed.REGIONS, "region string, region_name string, factor double")
