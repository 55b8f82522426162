"""Column expressions and operators over image headers: aliases, types, solutions of the sky, reducers, observatories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Focal reducers by their factor, and how near a measured one must be.
REDUCERS = ((0.67, "0.67x Reducer"), (0.72, "0.72x Reducer"), (0.73, "0.73x Reducer (Starizona)"), (0.75, "0.75x Reducer"), (0.80, "0.80x Reducer"), (0.85, "0.85x Reducer"), (1.00, "No Reducer (Native)"))
REDUCER_TOLERANCE = 0.03
# An observatory's telescopes (aperture, focal length, f-number), its cameras' pixels, and header texts that name them alone.
TELESCOPES = {"OHP T120": (1200.0, 7232.0, 6.03), "OHP IRIS": (500.0, 4072.0, 8.14)}
CAMERA_PIXELS = {"Andor iKon-L 936": 13.5, "Andor Marana 4.2B-11": 11.0, "FLI ProLine 2048": 13.5, "FLI ProLine 4096": 9.0}
TELESCOPE_TEXTS = {"OHP T120": "OHP T120", "T120 OHP": "OHP T120", "IRIS OHP": "OHP IRIS", "OHP IRIS": "OHP IRIS"}
CAMERA_TEXTS = {"PL0394113": "FLI ProLine 2048", "PL1344016": "FLI ProLine 4096", "ANDOR MARANA 4.2B-11": "Andor Marana 4.2B-11"}
ARCSEC = 206264.80624709636


def resolve_headers(cards: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, canonical, keyword, value): of each file's cards (path, keyword, value) the one of the best rank for each canonical key.

    ``aliases`` has keyword, canonical and rank, the canonical key itself at rank 0. Of repeated cards the smallest value is taken.
    """
    met = cards.join(aliases, "keyword").repartition("path", "canonical")  # a file has few cards of a key, and an aggregate of texts sorts, so a split of the file would be sorted whole
    best = met.groupBy("path", "canonical").agg(F.min_by(F.struct("keyword", "value"), F.struct("rank", "value")).alias("one"))
    return best.select("path", "canonical", "one.keyword", "one.value")


def coerce_header(value: Column, kind: str) -> Column:
    """A header's text as int (by way of a number), float, bool or string; blank is null, and so is what isn't a number."""
    text = F.nullif(F.trim(value), F.lit(""))
    if kind == "int":
        return text.try_cast("double").cast("long")
    if kind == "float":
        return text.try_cast("double")
    return F.upper(text).isin("TRUE", "T", "YES", "1") if kind == "bool" else text


def wcs_info(header: dict[str, Column]) -> dict[str, Column]:
    """solved, ra, dec, scale (arc seconds a pixel), rotation, width, height, fov_x and fov_y from header numbers (null where a key is absent)."""
    n = lambda k: header.get(k, F.lit(None)).cast("double")
    z = lambda k: F.coalesce(n(k), F.lit(0.0))
    plain = (F.abs(z("CDELT1")) + F.abs(z("CDELT2"))) / 2 * 3600
    matrix = (F.hypot(z("CD1_1"), z("CD2_1")) + F.hypot(z("CD1_2"), z("CD2_2"))) / 2 * 3600
    scale = F.when((z("CDELT1") != 0) & (z("CDELT2") != 0), plain).otherwise(matrix)
    solved = n("CRVAL1").isNotNull() & (scale > 0)
    turned = F.when((z("CD1_1") != 0) | (z("CD2_1") != 0), F.degrees(F.atan2(z("CD2_1"), z("CD1_1")))).otherwise(0.0)
    side = lambda k: F.when(z(f"NAXIS{k}").cast("int") != 0, z(f"NAXIS{k}").cast("int")).when(z(f"CRPIX{k}") > 0, (z(f"CRPIX{k}") * 2).cast("int")).otherwise(0)
    out = {"ra": z("CRVAL1"), "dec": z("CRVAL2"), "scale": scale, "rotation": F.coalesce(n("CROTA2"), turned), "width": side(1), "height": side(2), "fov_x": side(1) * scale / 3600, "fov_y": side(2) * scale / 3600}
    return {"solved": solved, **{k: F.when(solved, v) for k, v in out.items()}}


def detect_reducer(measured: Column, pixel_um: Column, focal_mm: Column) -> dict[str, Column]:
    """detected, ratio, measured_ratio, reducer_name, effective_focal_mm: the known factor nearest to measured over expected scale."""
    expected = F.nullif(pixel_um, F.lit(0)) / F.nullif(focal_mm, F.lit(0)) * 206.265
    ratio = measured / expected
    nearest = F.array_min(F.array(*(F.struct(F.abs(ratio - r).alias("gap"), F.lit(k).alias("place"), F.lit(r).alias("ratio"), F.lit(n).alias("name")) for k, (r, n) in enumerate(REDUCERS))))
    found = F.coalesce(nearest["gap"] <= REDUCER_TOLERANCE, F.lit(False))
    return {
        "detected": found, "ratio": F.when(expected.isNull(), 1.0).otherwise(F.round(F.when(found, nearest["ratio"]).otherwise(ratio), 3)), "measured_ratio": F.round(ratio, 4),
        "reducer_name": F.when(expected.isNull(), None).when(found, nearest["name"]).otherwise("Unknown"), "effective_focal_mm": F.round(F.when(found, focal_mm * nearest["ratio"]).otherwise(focal_mm), 1),
    }


def _text(c: Column) -> Column:
    raw = F.coalesce(c.cast("string"), F.lit(""))
    for mark, char in (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(mark), F.lit(char))
    return F.upper(F.trim(F.regexp_replace(F.trim(raw), "^'(.*)'$", "$1")))


def _number(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c.cast("string")), "^'|'$", "")).try_cast("double")


def _near(c: Column, value: float, tolerance: float) -> Column:
    return F.coalesce(F.abs(c - value) <= tolerance, F.lit(False))


def detect_observatory(header: dict[str, Column]) -> dict[str, Column]:
    """telescope, camera, binning, focal_length_mm, pixel_size_um, effective_pixel_um and image_scale_arcsec of a known observatory's frame, else nulls.

    ``header`` has TELESCOP, OBSERVAT, INSTRUME, APTDIA, FOCALLEN, XPIXSZ, XBINNING and NAXIS1. Texts name a telescope, and where they don't or are of a
    driver, aperture and focal length do; a camera is known by its texts, else by the unbinned pixel or width.
    """
    get = lambda k: header.get(k, F.lit(None))
    tel, obs, inst = (_text(get(k)) for k in ("TELESCOP", "OBSERVAT", "INSTRUME"))
    aperture, focal, pixel, width = (_number(get(k)) for k in ("APTDIA", "FOCALLEN", "XPIXSZ", "NAXIS1"))
    times = F.coalesce(F.nullif(_number(get("XBINNING")), F.lit(0.0)), F.lit(1.0))
    named = F.create_map(*(F.lit(x) for pair in TELESCOPE_TEXTS.items() for x in pair))[tel]
    technical = (tel == "") | tel.contains("->")
    by_size = F.when(technical & _near(aperture, 1200.0, 5.0) & _near(focal, 7232.0, 150.0), "OHP T120").when(technical & _near(aperture, 500.0, 2.0) & _near(focal, 4072.0, 40.0), "OHP IRIS")
    telescope = F.coalesce(named, F.when(obs == "IRIS", "OHP IRIS").when(tel.contains("OHP") & F.replace(tel, F.lit(" "), F.lit("")).contains("T120"), "OHP T120").when(tel.contains("OHP") & tel.contains("IRIS"), "OHP IRIS"), by_size)
    native, whole = F.when(times > 0, pixel / times), F.nullif(width, F.lit(0.0)) * times
    by_text = None
    for text, camera in CAMERA_TEXTS.items():
        by_text = (F.when if by_text is None else by_text.when)(inst.contains(text), camera)
    at = lambda name: F.coalesce(telescope == name, F.lit(False))
    by_pixel = (
        F.when(at("OHP T120") & (inst.contains("SCMOS") | inst.contains("MARANA") | _near(native, 11.0, 0.3)), "Andor Marana 4.2B-11").when(at("OHP T120") & (inst.contains("ANDOR") | inst.contains("IKON") | _near(native, 13.5, 0.2)), "Andor iKon-L 936")
        .when(at("OHP IRIS") & (_near(native, 13.5, 0.2) | (native.isNull() & _near(whole, 2048.0, 1.0))), "FLI ProLine 2048").when(at("OHP IRIS") & (_near(native, 9.0, 0.2) | (native.isNull() & _near(whole, 4096.0, 1.0))), "FLI ProLine 4096")
    )
    camera = F.when(telescope.isNotNull(), F.coalesce(by_text, by_pixel))
    focal_length = F.create_map(*(F.lit(x) for k, v in TELESCOPES.items() for x in (k, v[1])))[telescope]
    pixel_size = F.create_map(*(F.lit(x) for pair in CAMERA_PIXELS.items() for x in pair))[camera]
    binning = F.when(telescope.isNotNull(), times.cast("int"))
    effective = pixel_size * binning
    return {"telescope": telescope, "camera": camera, "binning": binning, "focal_length_mm": focal_length, "pixel_size_um": pixel_size, "effective_pixel_um": effective, "image_scale_arcsec": F.round(ARCSEC * effective * 1e-3 / focal_length, 3)}
