"""The stand-in views again, as DuckDB common table expressions for the checks.

``with_views`` puts the expressions a query refers to in front of it.
"""

from __future__ import annotations

import re


def r(expr: str, digits: int = 6) -> str:
    """Rounded, with negative zero turned to zero as Spark's ``round`` gives it."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def region_sql(key: str) -> str:
    return f"(CASE {key} % 3 WHEN 0 THEN '04hf3' WHEN 1 THEN '05LE4' ELSE '09gd4' END)"


def hash_sql(*keys: str, seed: int = 0) -> str:
    factors = [7919, 104729, 1299709, 31, 17, 15485863]
    terms = " + ".join(f"(CAST({k} AS BIGINT) % 1000003) * {f}" for k, f in zip(keys, factors))
    return f"((({seed * 97 % 1000003} + {terms}) % 1000003) * 48271 % 1000003)"


FID = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       "CAST(l_quantity AS BIGINT))")
RH = "(l_quantity + (l_extendedprice - 52000.0) / 6000.0)"

VIEWS: dict[str, str] = {
    "footprints": f"""SELECT {FID} AS fid,
      {hash_sql('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity')} AS hkey,
      l_suppkey AS patch_num, l_orderkey AS granule_key,
      CAST(l_orderkey % 64 AS INT) AS row, CAST(l_partkey % 64 AS INT) AS col,
      {region_sql('l_suppkey')} AS region,
      134.0::DOUBLE + (l_partkey % 1000)::DOUBLE / 1000.0::DOUBLE AS longitude,
      34.0::DOUBLE + (l_orderkey % 1000)::DOUBLE / 1000.0::DOUBLE AS latitude,
      l_shipdate AS ts, {RH} AS rh, l_quantity AS reference_height,
      CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS quality_flag, 0 AS degrade_flag,
      1.0::DOUBLE - l_discount AS sensitivity, l_linenumber AS beam,
      l_tax * 100.0::DOUBLE - 4.0::DOUBLE AS solar_elevation,
      CAST(1 + l_orderkey % 3 AS INT) AS num_detectedmodes,
      l_extendedprice / 60.0 AS elev_lowestmode,
      l_extendedprice / 60.0 - l_discount * 600.0 AS srtm,
      CASE WHEN l_partkey % 7 <> 0 THEN l_quantity * 0.7::DOUBLE + l_linenumber * 1.0::DOUBLE END AS ch_potapov2021,
      l_quantity * 1.1::DOUBLE - l_tax * 30.0::DOUBLE AS ch_lang2022,
      CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 0.8::DOUBLE + l_discount * 40.0::DOUBLE END AS ch_tolan2024,
      CASE WHEN l_suppkey % 5 <> 0 THEN l_quantity * 0.9::DOUBLE + l_tax * 50.0::DOUBLE END AS ch_pauls2024,
      l_discount AS mean_asm, l_tax AS mean_contrast, (l_extendedprice + (l_partkey % 97) * 500.0::DOUBLE) / 99991.0 AS mean_corr,
      l_extendedprice / 1000.0 - l_quantity AS mean_var,
      CASE WHEN l_partkey % 13 <> 0 THEN l_extendedprice / l_quantity / 1013.0 END AS mean_ent,
      l_linenumber * 2.0::DOUBLE AS median_savg
      FROM lineitem""",
    "predictions": f"""SELECT {region_sql('l_suppkey')} AS region, l_suppkey AS patch_num,
      CAST(l_orderkey % 64 AS INT) AS row, CAST(l_partkey % 64 AS INT) AS col,
      {FID} AS patch_order, CASE WHEN l_linenumber <> 7 THEN {RH} END AS pred FROM lineitem""",
    "first_lines": f"""SELECT *, CAST(l_orderkey % 64 AS INT) AS row, CAST(l_partkey % 64 AS INT) AS col
      FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 64, l_partkey % 64 ORDER BY {FID}) = 1""",
    "pixels": f"""SELECT l_suppkey AS patch_num, row, col,
      'patch' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS patch_id,
      {region_sql('l_suppkey')} AS region,
      {hash_sql('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity')} AS hkey,
      l_quantity * 0.3::DOUBLE - 25.0::DOUBLE AS "S1_VV", l_tax * 100.0::DOUBLE - 31.0::DOUBLE AS "S1_VH",
      l_extendedprice / 20.0 AS "B4", l_quantity * 150.0::DOUBLE AS "B8",
      l_extendedprice / 10.0 AS "ALOS2_HH", l_extendedprice / 25.0 AS "ALOS2_HV",
      l_extendedprice / 60.0 AS "DEM", l_tax * 500.0::DOUBLE AS slope,
      CAST(l_partkey % 360 AS DOUBLE) AS aspect,
      CASE WHEN l_partkey % 7 <> 0 THEN l_quantity * 0.7::DOUBLE + l_linenumber * 1.0::DOUBLE END AS ch_potapov2021,
      l_quantity * 1.1::DOUBLE - l_tax * 30.0::DOUBLE AS ch_lang2022,
      CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 0.8::DOUBLE + l_discount * 40.0::DOUBLE END AS ch_tolan2024,
      CASE WHEN l_suppkey % 5 <> 0 THEN l_quantity * 0.9::DOUBLE + l_tax * 50.0::DOUBLE END AS ch_pauls2024,
      CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS forest_mask,
      CASE WHEN l_orderkey % 3 = 0 AND l_suppkey % 6 <> 1 THEN {RH} END AS rh,
      l_quantity AS reference_height,
      CASE WHEN l_linenumber <> 7 THEN {RH} END AS pred,
      l_quantity * 0.9::DOUBLE + l_discount * 50.0::DOUBLE AS pred_b
      FROM first_lines""",
    "patches": """SELECT patch_num, patch_id, region, count(*) AS n_pixels, count(rh) AS n_rh,
      (patch_num % 10) * 600.0::DOUBLE AS min_x, (patch_num // 10) * 600.0::DOUBLE AS min_y,
      (patch_num % 10) * 600.0::DOUBLE + 640.0::DOUBLE AS max_x,
      (patch_num // 10) * 600.0::DOUBLE + 640.0::DOUBLE AS max_y,
      CASE WHEN patch_num % 4 = 0 THEN 196 WHEN patch_num % 2 = 1 THEN 31 ELSE 30 END AS band_count,
      patch_num % 4 = 0 AS temporal, 'EPSG:32653' AS crs, 10.0::DOUBLE AS pixel_size
      FROM pixels GROUP BY patch_num, patch_id, region""",
    "reference_cells": f"""SELECT region, row, col,
      CASE WHEN (row * 64 + col) % 17 = 0 THEN -32767.0::DOUBLE ELSE v END AS value,
      CASE WHEN (row + col) % 3 <> 0 THEN 1 ELSE 0 END AS mask
      FROM (SELECT {region_sql('l_suppkey')} AS region, CAST(l_orderkey % 64 AS INT) AS row,
            CAST(l_partkey % 64 AS INT) AS col, arg_min(l_quantity, {FID}) AS v
            FROM lineitem GROUP BY 1, 2, 3)""",
    "patch_grids": f"""SELECT DISTINCT {region_sql('l_suppkey')} AS region, l_suppkey AS patch_num, 32653 AS code,
      (l_suppkey % 10) * 1900.0::DOUBLE + 770000.0::DOUBLE AS "left", 3880000.0::DOUBLE - (l_suppkey // 10) * 1900.0::DOUBLE AS top,
      CASE WHEN l_suppkey % 4 = 0 THEN 12.0::DOUBLE ELSE 30.0::DOUBLE END AS res, 64 AS rows, 64 AS cols FROM lineitem""",
    "reference_grids": """SELECT DISTINCT region, 32654 AS code, 220000.0::DOUBLE AS "left", 3884000.0::DOUBLE AS top,
      800.0::DOUBLE AS res, 64 AS rows, 64 AS cols FROM reference_cells""",
    "observations": f"""SELECT {FID} AS obs_id, l_suppkey * 16 + l_partkey % 16 AS px,
      'S2_' || (l_orderkey % 500) AS scene_id, l_shipdate AS ts,
      CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
      l_quantity * 0.3::DOUBLE - 25.0::DOUBLE AS "VV", l_tax * 100.0::DOUBLE - 31.0::DOUBLE AS "VH",
      l_extendedprice / 20.0 AS "B4", l_quantity * 150.0::DOUBLE AS "B8",
      CASE WHEN l_linenumber <> 7 THEN l_quantity * 120.0::DOUBLE END AS "B8A",
      CASE WHEN l_partkey % 19 <> 0 THEN l_quantity * 90.0::DOUBLE END AS "B9",
      l_extendedprice / 10.0 AS "HH", CASE WHEN l_linenumber <> 6 THEN l_extendedprice / 25.0 END AS "HV",
      l_discount * 1000.0::DOUBLE AS probability, l_tax * 500.0::DOUBLE AS cloudy_pct,
      CAST((l_orderkey % 4) * 1024 AS INT) AS qa60, l_linenumber % 4 AS dw_label,
      l_linenumber % 4 + 1 AS fnf4, l_linenumber % 3 + 1 AS fnf,
      CASE WHEN l_partkey % 16 % 3 = 0 THEN 10 ELSE 40 END AS wc, l_quantity - 2.0::DOUBLE AS chm
      FROM lineitem""",
    "scenes": """SELECT event_id, event_type || '_' || strftime(ts, '%Y%m%d') AS scene_id,
      event_type AS sensor, ts, user_id AS px, value,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) AS probability,
      CASE WHEN event_id % 5 = 0 THEN 'EW' ELSE 'IW' END AS instrument_mode,
      CASE WHEN event_id % 7 = 0 THEN 40 ELSE 10 END AS resolution_meters,
      CASE WHEN event_id % 3 = 0 THEN ['HH'] ELSE ['VV', 'VH'] END AS pols FROM events""",
    "granules": """SELECT granule_key, min(ts) AS time_start, max(ts) AS time_end,
      min(longitude) AS min_lon, max(longitude) AS max_lon,
      min(latitude) AS min_lat, max(latitude) AS max_lat FROM footprints GROUP BY granule_key""",
    "embedding_pixels": """SELECT vec_id, CAST(vec_id // 64 AS INT) AS patch_num,
      CAST((vec_id % 64) // 8 AS INT) AS row, CAST(vec_id % 8 AS INT) AS col, label, embedding
      FROM embeddings""",
    "embedding_wide": "SELECT vec_id, patch_num, row, col, label, "
      + ", ".join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS "A{i:02d}"' for i in range(64))
      + " FROM embedding_pixels",
    "files": f"""SELECT doc_id, source AS run, lang, n_chars AS size,
      'outputs/' || source || '/' || CASE doc_id % 5
        WHEN 0 THEN 'dchm_' || {region_sql('doc_id')} || '_embedding_bandNum70_scale10_patch' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '.tif'
        WHEN 1 THEN 'dchm_' || {region_sql('doc_id')} || '_temporal_bandNum196_scale10_patch' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '.tif'
        WHEN 2 THEN 'rf_dchm_' || {region_sql('doc_id')} || '_patch' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '_prediction.tif'
        WHEN 3 THEN 'mlp_dchm_' || {region_sql('doc_id')} || '_run' || lang || '_prediction.tif'
        ELSE 'gedi_embedding_mosaic_b64_' || lang || '_with_reference.csv' END AS path
      FROM documents""",
    "regions": """SELECT * FROM (VALUES ('04hf3', 'Kochi', 2.5::DOUBLE), ('05LE4', 'Hyogo', 1.0::DOUBLE),
      ('09gd4', 'Tochigi', 3.7::DOUBLE)) t(region, region_name, factor)""",
}


def _mentions(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]


def with_views(body: str) -> str:
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in _mentions(sql):
            if name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
