"""Names, codes and limits that results depend on."""

# Height columns of a footprint table.
HEIGHT_COLUMNS = [
    "reference_height", "rh", "ch_potapov2021", "ch_lang2022", "ch_tolan2024", "ch_pauls2024",
]
PRODUCT_COLUMNS = HEIGHT_COLUMNS[2:]

# Height source of each patch band.
HEIGHT_SOURCES = {
    "rh": "GEDI",
    "ch_pauls2024": "Pauls2024",
    "ch_tolan2024": "Tolan2024",
    "ch_lang2022": "Lang2022",
    "ch_potapov2021": "Potapov2021",
}

# Order in which a missing reference height is replaced.
REFERENCE_FALLBACK = [
    "reference_height", "ch_pauls2024", "ch_tolan2024", "ch_lang2022", "ch_potapov2021",
]

# Region code, region name, systematic bias factor.
REGIONS = [("04hf3", "Kochi", 2.5), ("05LE4", "Hyogo", 1.0), ("09gd4", "Tochigi", 3.7)]
AREA_PREFIX = "dchm_"

# Limits of agreement between heights, and of a good footprint, in metres.
AGREEMENT_M = 5.0
QUALITY_M = 10.0

# Left edges of the height classes.
HEIGHT_EDGES = [0.0, 5.0, 10.0, 15.0, 20.0, 30.0, 50.0, 100.0]
MOSAIC_EDGES = [0.0, 5.0, 10.0, 20.0, 30.0, 50.0, 100.0]

# Band groups.
EMBEDDING_BANDS = [f"A{i:02d}" for i in range(64)]
S2_REFLECTANCE = ["B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12"]
AUXILIARY_BANDS = [
    "ch_pauls2024", "ch_tolan2024", "ch_lang2022", "ch_potapov2021", "forest_mask",
]
TARGET_BANDS = ["rh", "reference_height"]
# Channel order of one month of the temporal stack.
MONTH_CHANNELS = (
    ["S1_VV", "S1_VH"] + [f"S2_{b}" for b in S2_REFLECTANCE] + ["S2_NDVI", "ALOS2_HH", "ALOS2_HV"]
)
# Names by position of a non-temporal stack without descriptions.
STATIC_BANDS = (
    ["S1_VV", "S1_VH"] + [f"S2_{b}" for b in S2_REFLECTANCE]
    + ["S2_NDVI", "ALOS2_HH", "ALOS2_HV", "DEM", "slope", "aspect", "canopy_height"]
)
TEMPORAL_BAND_COUNT = 196

# Band counts of unlabelled and labelled patches.
UNLABELLED_BANDS = 30
LABELLED_BANDS = 31

# Scale in metres -> patch size in metres, pixels per side.
RESOLUTIONS = {10: (2560, 256), 20: (2560, 128), 30: (2560, 85)}

# Codes that mean "no data".
NODATA_CODES = [-9999.0, -32767.0, -99999.0]

METRES_PER_DEGREE = 111320.0

# Pattern of a band's name, offset, divisor, least and greatest value (none: not cut).
BAND_RULES = [
    (r"S1_.*", 25.0, 25.0, None, None),
    ("|".join(S2_REFLECTANCE), 0.0, 10000.0, 0.0, 1.0),
    ("NDVI", 0.0, 1.0, -1.0, 1.0),
]
