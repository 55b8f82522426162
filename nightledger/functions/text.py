"""Column expressions over names, markers and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing number.
MISSING = ("", "-", "N/A", "NaN", "nan", "null")
# Timestamp layouts in the order in which they are tried.
TIMESTAMPS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
# Catalogue prefixes as they are written.
PREFIXES = ("M", "NGC", "IC", "Sh2", "LBN", "LDN", "Ced", "Abell", "Arp", "Barnard", "B", "C", "PGC", "UGC", "vdB", "RCW", "Cr", "Mel", "Tr", "Stock")
# Catalogues by priority.
PRIORITY = {"M": 1, "NGC": 2, "IC": 3, "CALDWELL": 4, "C": 4, "SH2": 5, "ABELL": 6, "ARP": 7, "BARNARD": 8, "B": 8, "LBN": 9, "PGC": 10, "VDB": 11, "LDN": 12, "RCW": 13, "CED": 14}
# Words in the names of calibration targets.
CALIBRATION = ("dark", "flat", "bias", "offset", "flatfield", "darkframe", "biasframe", "calibration", "test", "snapshot")
# Spellings of the image types.
IMAGE_TYPES = {
    "LIGHT": ("light", "light frame", "science", "science frame", "object"),
    "DARK": ("dark", "dark frame"),
    "FLAT": ("flat", "flat frame", "flat field", "flatfield", "skyflat", "sky flat", "twilight flat"),
    "BIAS": ("bias", "bias frame", "offset", "offset frame", "zero", "zero frame"),
    "DARKFLAT": ("darkflat", "dark flat", "dark flat frame"),
}


def safe_double(c: Column) -> Column:
    """A number, or null for the missing markers, for other text and for NaN."""
    value = F.trim(c).try_cast("double")
    return F.when(~F.trim(c).isin(*MISSING) & ~F.isnan(value), value)


def safe_int(c: Column) -> Column:
    """``safe_double`` rounded half to even."""
    return F.bround(safe_double(c)).cast("long")


def parse_timestamp(c: Column) -> Column:
    """The first layout that fits; month before day where both could be."""
    exact = F.regexp_replace(F.trim(c), r"(\.\d{6})\d+$", "$1")
    padded = F.when(exact.rlike(r"\.\d{1,5}$"), F.rpad(exact, 26, "0")).otherwise(exact)
    return F.coalesce(*(F.try_to_timestamp(padded, F.lit(layout)) for layout in TIMESTAMPS))


def night_date(ts: Column) -> Column:
    """The date of the evening: before noon belongs to the day before."""
    return F.to_date(ts - F.expr("INTERVAL 12 HOURS"))


def astro_night(ts: Column, longitude: Column) -> Column:
    """The date of the evening where the day begins at local solar noon, 12 - longitude / 15 hours UTC."""
    micros = F.unix_micros(ts.cast("timestamp")) + (longitude / 15 * 3_600_000_000).cast("long") - 43_200_000_000
    return F.to_date(F.timestamp_micros(micros))


def normalize_target(c: Column) -> Column:
    """'M31' becomes 'M 31', 'NGC0224' 'NGC 224', 'sh2 240' 'Sh2-240'; other names keep their words."""
    tidy = F.trim(F.regexp_replace(c, r"\s+", " "))
    pattern = "(?i)^(" + "|".join(sorted((p if p != "Sh2" else r"Sh\s*2" for p in PREFIXES), key=len, reverse=True)) + r")[\s\-]*(\d+.*)$"
    prefix = F.lower(F.regexp_replace(F.regexp_extract(tidy, pattern, 1), r"\s", ""))
    number = F.ltrim(F.regexp_extract(tidy, pattern, 2), F.lit("0"))
    written = F.create_map(*(x for p in PREFIXES for x in (F.lit(p.lower()), F.lit(p))))[prefix]
    joint = F.when(prefix == "sh2", "-").otherwise(" ")
    return F.when(written.isNotNull(), F.concat(written, joint, F.when(number == "", "0").otherwise(number))).otherwise(tidy)


def catalog_priority(c: Column) -> Column:
    """1 for the best known catalogue to 14; 99 for other names."""
    name = F.upper(F.trim(c))
    best = F.lit(None).cast("int")
    for prefix, rank in reversed(PRIORITY.items()):
        best = F.when(name.rlike(rf"^{prefix}($|[\s\-_]*\d)"), rank).otherwise(best)
    return F.coalesce(best, F.lit(99))


def is_calibration_target(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike("|".join(CALIBRATION)), F.lit(False))


def normalize_image_type(c: Column) -> Column:
    """LIGHT, DARK, FLAT, BIAS or DARKFLAT by spelling, else by what the text holds, else LIGHT."""
    word = F.lower(F.trim(c))
    known = F.create_map(*(x for kind, words in IMAGE_TYPES.items() for w in words for x in (F.lit(w), F.lit(kind))))[word]
    held = F.when(word.rlike("light|science"), "LIGHT").when(word.contains("darkflat"), "DARKFLAT").when(word.contains("dark"), "DARK").when(word.contains("flat"), "FLAT").when(word.rlike("bias|offset|zero"), "BIAS")
    return F.coalesce(known, held, F.lit("LIGHT"))


def sexagesimal_to_degrees(c: Column) -> Column:
    """'-12:30:36' becomes -12.51."""
    parts = F.split(F.regexp_replace(F.trim(c), r"^[+-]", ""), "[: ]+")
    size = parts[0].try_cast("double") + F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)) / 60 + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)) / 3600
    return F.when(F.trim(c).startswith("-"), -size).otherwise(size)


def target_from_path(path: Column) -> Column:
    """The nearest of the three folders above LIGHT, DARK, FLAT, BIAS or DARKFLAT, past folders such as Night_2; null where a dated folder or an observatory's
    comes first, or where the name is of a calibration target."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    kind = F.coalesce(F.array_max(F.transform(folders, lambda x, i: F.when(F.upper(x).isin("LIGHT", "DARK", "FLAT", "BIAS", "DARKFLAT"), i))), F.lit(0))
    above = F.reverse(F.slice(folders, F.greatest(kind - 2, F.lit(1)), F.least(kind, F.lit(3))))
    skipped, stops = r"(?i)^(nuit|night|session)[_\- ]?\d+", r"(?i)^.{4}-.{2}-.{2}|^observatoire"
    # the first folder that isn't skipped; '/' marks that the search has ended without a name
    first = F.aggregate(above, F.lit("").cast("string"), lambda have, x: F.when(have != "", have).when(x.rlike(skipped) | (x == ""), have).when(x.rlike(stops), F.lit("/")).otherwise(x))
    name = F.regexp_replace(F.trim(first), r"\s+", " ")
    return F.when((name != "") & (name != "/") & ~is_calibration_target(name), name)


def format_duration(seconds: Column) -> Column:
    """'3h 05m' or '5m'."""
    hours, minutes = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return F.when(hours > 0, F.format_string("%dh %02dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))
