"""Column expressions over catalogue numbers, filters, cameras, equipment texts and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Catalogue spellings and the prefix each is written with.
CATALOGUES = (
    (r"^M(?:ESSIER)?\s*(\d+)$", "M"), (r"^NGC\s*0*(\d+[A-Z]?)$", "NGC "), (r"^IC\s*0*(\d+[A-Z]?)$", "IC "), (r"^C(?:ALDWELL)?\s*(\d+)$", "Caldwell "), (r"^SH\s*2?\s*[-_ ]?\s*(\d+)$", "Sh2-"),
    (r"^ABELL\s*(\d+)$", "Abell "), (r"^ARP\s*(\d+)$", "Arp "), (r"^B(?:ARNARD)?\s*(\d+)$", "B "), (r"^LBN\s*(\d+)$", "LBN "), (r"^PGC\s*(\d+)$", "PGC "), (r"^VDB\s*(\d+)$", "vdB "), (r"^LDN\s*(\d+)$", "LDN "),
    (r"^RCW\s*(\d+)$", "RCW "), (r"^CED\s*(\d+[A-Z]?)$", "Ced "),
)
# Greek letters in ASCII.
GREEK = {
    "α": "a", "Α": "A", "β": "b", "Β": "B", "γ": "g", "Γ": "G", "δ": "d", "Δ": "D", "ε": "e", "Ε": "E", "ζ": "z", "Ζ": "Z", "η": "e", "Η": "E", "θ": "th", "Θ": "TH", "ι": "i", "Ι": "I", "κ": "k", "Κ": "K",
    "λ": "l", "Λ": "L", "μ": "mu", "Μ": "MU", "ν": "n", "Ν": "N", "ξ": "x", "Ξ": "X", "ο": "o", "Ο": "O", "π": "pi", "Π": "PI", "ρ": "r", "Ρ": "R", "σ": "s", "Σ": "S", "ς": "s", "τ": "t", "Τ": "T", "υ": "u",
    "Υ": "U", "φ": "ph", "Φ": "PH", "χ": "ch", "Χ": "CH", "ψ": "ps", "Ψ": "PS", "ω": "o", "Ω": "O",
}
# The commonest spellings of filters; larger tables are a parameter.
FILTER_ALIASES = {
    "LUMINANCE": "L", "LUM": "L", "CLR": "L", "RED": "R", "GREEN": "G", "BLUE": "B", "H-ALPHA": "Ha", "HALPHA": "Ha", "HA": "Ha", "H_ALPHA": "Ha", "H-BETA": "Hb", "HBETA": "Hb", "HB": "Hb", "O-III": "OIII", "O3": "OIII", "[OIII]": "OIII",
    "S-II": "SII", "S2": "SII", "[SII]": "SII", "N-II": "NII", "N2": "NII", "[NII]": "NII",
}
# Filters of the catalogue that these spellings name, with their kinds.
FILTER_KINDS = {"L": "luminance", "R": "broadband", "G": "broadband", "B": "broadband", "Ha": "narrowband", "Hb": "narrowband", "OIII": "narrowband", "SII": "narrowband", "NII": "narrowband"}
# Beginnings of camera names that name a brand.
BRANDS = (("ASI", "ZWO"), ("QHY", "QHY"), ("FLI", "FLI"), ("STF", "SBIG"), ("STT", "SBIG"), ("ATIK", "Atik"), ("CANON", "Canon"), ("NIKON", "Nikon"), ("SONY", "Sony"), ("IMX", "Sony"), ("PLAYER", "Player One"), ("SVBONY", "SVBONY"), ("Touptek", "Touptek"), ("SIGMA", "Sigma"))
# Brand words that may stand before a camera's name.
BRAND_WORDS = ("ZWO ", "QHY ", "FLI ", "SBIG ", "ATIK ", "MORAVIAN ", "PLAYER ONE ", "SVBONY ", "TOUPTEK ", "CANON ", "NIKON ", "SONY ")
# Marks of monochrome and of colour cameras, and brands whose cameras all are of colour.
MONO, COLOUR, COLOUR_BRANDS = ("MM", "MONO", "-M ", "-M-"), ("MC", "OSC", "COLOR", "-C", " C ", "COLOUR"), ("CANON", "NIKON", "SONY", "SIGMA", "PENTAX", "FUJI")
# Words of descriptions by kind of object, in the order in which they are looked for.
OBJECT_WORDS = (
    ("Galaxy", ("galaxy", "galax", "spiral", "elliptical", "lenticular", "barred", "irregular gal")), ("Planetary Nebula", ("planetary nebula", "planétaire")),
    ("Nebula", ("nebula", "nébuleuse", "emission", "reflection", "dark ", "hii", "supernova remnant")), ("Cluster", ("cluster", "amas", "globular", "open cluster", "star cloud")),
    ("Planet/Moon", ("planet", "moon", "comet", "asteroid", "sun", "mercury", "venus", "mars", "jupiter", "saturn")),
)
# Endings, beginnings and folders of processed images, and header keys that name the program.
PROCESSED_ENDS = ("_c.xisf", "_d.xisf", "_r.xisf", "_cc.xisf", "_cal.xisf", "_cal.fits", "_drizzle.xisf", "_drizzle.fits", "_abe.xisf", "_abe.fits", "_dbe.xisf", "_dbe.fits", "_star.xisf", "_star.fits", "_starless.xisf", "_starless.fits")
PROCESSED_STARTS, PROCESSED_FOLDERS = ("master", "calibrated", "registered", "integrated"), ("calibrated", "registered", "integrated", "process", "masters", "output")
# Filters that one letter names rightly.
ONE_LETTER = ("L", "R", "G", "B", "V", "U", "I")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def normalize_catalog_id(c: Column) -> Column:
    """'M 31' becomes 'M31', 'NGC0224' 'NGC 224', 'Sh2 240' 'Sh2-240'; other names are trimmed, null is ''."""
    name, out = F.trim(F.coalesce(c, F.lit(""))), None
    for pattern, prefix in CATALOGUES:
        number = F.regexp_extract(name, "(?i)" + pattern, 1)
        bare = F.regexp_replace(number, "^0+(?=.)", "")
        out = (F.when if out is None else out.when)(number != "", F.concat(F.lit(prefix), F.when(bare.rlike("^[A-Za-z]$"), F.concat(F.lit("0"), bare)).otherwise(bare)))
    return out.otherwise(name)


def greek_to_ascii(c: Column) -> Column:
    out = F.trim(c)
    for letters in (k for k, v in GREEK.items() if len(v) > 1):
        out = F.replace(out, F.lit(letters), F.lit(GREEK[letters]))
    single = {k: v for k, v in GREEK.items() if len(v) == 1}
    return F.translate(out, "".join(single), "".join(single.values()))


def aliases_frame(spark, aliases: dict[str, str] = FILTER_ALIASES, names: tuple[str, ...] = tuple(FILTER_KINDS)) -> DataFrame:
    """alias, canonical and rank, as ``normalize_by_aliases`` takes them: spellings first, then the catalogue's own names."""
    rows = [(a, c, k, True) for k, (a, c) in enumerate(aliases.items())] + [(n.upper(), n, 100_000 + k, False) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "alias string, canonical string, rank long, partial boolean")


def _grams(c: Column) -> Column:
    """The distinct pieces of one to three characters of a text."""
    of = lambda size: F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda at: F.substring(c, at, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def containing(holders: DataFrame, holder: str, held: DataFrame, part: str) -> DataFrame:
    """All columns of both sides where the text ``holder`` holds the text ``part``, '' holding and being held by nothing.

    An inverted index: a held text is looked up by its rarest piece of three characters (all of it where it is shorter) among the pieces of the holders, and verified.
    How often a piece is in holders is counted first, so a piece that all of them have is a key only of texts that have no other.
    """
    index = holders.where(F.col(holder) != "").withColumn("_gram", F.explode(_grams(F.col(holder))))
    often = index.groupBy("_gram").agg(F.count("*").alias("_often"))
    texts = held.where(F.col(part) != "").select(F.col(part).alias("_part")).distinct()
    whole = texts.withColumn("_gram", F.explode(F.filter(_grams(F.col("_part")), lambda g: F.length(g) == F.least(F.length("_part"), F.lit(3)))))
    counted = whole.join(often, "_gram", "left").groupBy("_part").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_gram")).alias("_rare")).where("_rare.n > 0")  # a piece in no holder: held by none
    met = index.join(counted.select("_part", F.col("_rare._gram").alias("_gram")), "_gram").where(F.col(holder).contains(F.col("_part")))
    return met.drop("_gram").join(held.withColumn("_own", F.col(part)), F.col("_part") == F.col("_own")).drop("_part", "_own")


def normalize_by_aliases(df: DataFrame, column: str, aliases: DataFrame, out: str, least: int = 3) -> DataFrame:
    """Adds ``out``: the canonical name of the alias that equals the upper-cased name, else of the first (by rank) alias of ``least`` characters or more
    that the name holds (``partial`` ones only), else the name itself; null and blank names are ''.

    Names are looked up once each: distinct names meet the aliases by equality or by ``containing``, and the outcome is joined back.
    """
    names = df.select(F.col(column).alias("_name")).distinct().withColumn("_upper", F.upper(F.trim("_name")))
    exact = names.join(aliases, F.col("_upper") == F.col("alias")).select("_name", "canonical", F.col("rank").alias("_rank"))
    near = containing(names, "_upper", aliases.where("partial").where(F.length("alias") >= least), "alias").select("_name", "canonical", (F.col("rank") + 1_000_000).alias("_rank"))
    best = exact.unionByName(near).groupBy("_name").agg(F.min_by("canonical", "_rank").alias("_found"))
    joined = df.join(best, F.col(column).eqNullSafe(F.col("_name")), "left")
    return joined.withColumn(out, F.coalesce("_found", F.trim(column), F.lit(""))).drop("_name", "_found")


def strip_brand(c: Column) -> Column:
    """A camera's name without the brand before it."""
    name = F.trim(c)
    return F.trim(F.regexp_replace(name, "(?i)^(" + "|".join(w.strip() for w in BRAND_WORDS) + ") +", ""))


def normalize_camera(df: DataFrame, column: str, mapping: DataFrame, models: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: what ``mapping`` (alias in capitals, canonical) says of the name, else of it without its brand, else the model of that very
    name, else the first of ``models`` (model, rank) that the name holds or that holds the name, else the name; null and blank names are ''.
    """
    names = df.select(F.col(column).alias("_name")).distinct().where(F.trim("_name") != "").withColumn("_upper", F.upper(F.trim("_name"))).withColumn("_bare", strip_brand(F.col("_name")))
    by = lambda key, level: names.join(mapping, F.upper(F.col(key)) == F.col("alias")).select("_name", "canonical", F.lit(level).alias("_rank"))
    own = names.where(F.upper("_bare") != F.col("_upper")).join(models, F.col("_bare") == F.col("model")).select("_name", F.col("model").alias("canonical"), F.lit(2).alias("_rank"))
    big = models.withColumn("_big", F.upper("model"))
    close = containing(names, "_upper", big, "_big").unionByName(containing(big, "_big", names, "_upper"))
    near = close.select("_name", F.col("model").alias("canonical"), (F.col("rank") + 3).alias("_rank"))
    best = by("_upper", 0).unionByName(by("_bare", 1)).unionByName(own).unionByName(near).groupBy("_name").agg(F.min_by("canonical", "_rank").alias("_found"))
    return df.join(best, F.col(column) == F.col("_name"), "left").withColumn(out, F.coalesce("_found", F.trim(column), F.lit(""))).drop("_name", "_found")


def is_color_camera(c: Column) -> Column:
    """False for a mono mark, true for a colour mark or brand, else null."""
    name = F.upper(c)
    has = lambda marks: any_of([name.contains(m) for m in marks])
    return F.when(name == "", None).when(has(MONO), False).when(has(COLOUR) | has(COLOUR_BRANDS), True)


def camera_brand(c: Column) -> Column:
    out = None
    for start, brand in BRANDS[:6]:
        out = (F.when if out is None else out.when)(c.startswith(start), brand)
    out = out.when(c.startswith("G") & F.substring(c, 1, 3).rlike(r"\d"), "Moravian")
    for start, brand in BRANDS[6:]:
        out = out.when(c.startswith(start), brand)
    return out.otherwise("Other")


def object_type(description: Column) -> Column:
    text, out = F.lower(description), None
    for kind, words in OBJECT_WORDS:
        out = (F.when if out is None else out.when)(any_of([text.contains(w) for w in words]), kind)
    return out.otherwise("Other")


def catalog_of(key: Column) -> Column:
    k = F.upper(key)
    is_c = k.startswith("C ") & F.trim(F.substring(k, 3, 100)).rlike(r"^\d+$")
    return F.when(k.startswith("NGC"), "NGC").when(k.startswith("IC"), "IC").when(k.rlike("^(SH2|SH |SHARPLESS)"), "Sharpless").when(k.rlike("^(B |BARNARD)"), "Barnard").when(k.startswith("CALDWELL") | is_c, "Caldwell").when(k.startswith("ARP"), "Arp").otherwise("Other")


def is_processed_path(path: Column) -> Column:
    """Whether a path is of a processed image, by the file name's ending or beginning or by a folder."""
    parts = F.split(F.lower(path), "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    return any_of([name.endswith(e) for e in PROCESSED_ENDS]) | any_of([name.startswith(s) for s in PROCESSED_STARTS]) | F.arrays_overlap(folders, F.array(*map(F.lit, PROCESSED_FOLDERS)))


def is_processed_header(software: Column, products: tuple[str, ...]) -> Column:
    """Whether a header's program names one of ``products``; null is not."""
    return F.coalesce(any_of([F.lower(software).contains(p) for p in products]), F.lit(False))


def clean_equipment(c: Column) -> Column:
    """"['A', 'B']" becomes 'A, B'; of comma-separated parts those that a longer part holds go; parts are sorted."""
    listed = F.trim(c).startswith("[") & F.trim(c).endswith("]")
    plain = F.when(listed, F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(F.regexp_replace(c, r"^\s*\[|\]\s*$", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")))), ", ")).otherwise(c)
    parts = F.filter(F.transform(F.split(plain, ","), lambda x: F.trim(x)), lambda p: p != "")
    by_length = F.array_sort(parts, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    kept = F.aggregate(by_length, F.array().cast("array<string>"), lambda have, p: F.when(F.exists(have, lambda h: F.contains(F.lower(h), F.lower(p))), have).otherwise(F.concat(have, F.array(p))))
    return F.when(F.size(parts) <= 1, plain).otherwise(F.array_join(F.array_sort(kept), ", "))


def setup_of(telescope: Column, camera: Column) -> Column:
    t, c = F.coalesce(telescope, F.lit("")), F.coalesce(camera, F.lit(""))
    return F.when((t != "") & (c != ""), F.concat(t, F.lit(" + "), c)).when(t != "", t).otherwise(c)


def repair_filters(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: 'H?' and 'H' are 'HA'; Greek is turned to ASCII capitals; another single letter that is not a filter of its own is completed if just one
    longer name of the column begins with it. Distinct names meet by first letter."""
    names = df.select(F.col(column).alias("_name")).where(F.col(column).isNotNull()).distinct()
    longer = names.where((F.length("_name") > 1)).groupBy(F.substring("_name", 1, 1).alias("_first")).agg(F.count("*").alias("_n"), F.min("_name").alias("_whole"))
    fixed = names.join(longer, F.col("_name") == F.col("_first"), "left")
    plain = F.upper(greek_to_ascii(F.col("_name")))
    single = (plain == F.col("_name")) & F.col("_name").rlike("^[A-Za-z]$") & ~F.col("_name").isin(*ONE_LETTER) & (F.col("_n") == 1)
    value = F.when(F.col("_name").isin("H?", "H"), "HA").when(single, F.col("_whole")).otherwise(plain)
    return df.join(fixed.select("_name", value.alias("_new")), F.col(column) == F.col("_name"), "left").withColumn(out, F.col("_new")).drop("_name", "_new")


def palette(names: Column, dual: Column | None = None) -> Column:
    """The palette of a set of canonical filter names (an array); ``dual`` says whether one of them passes two bands."""
    has = lambda n: F.array_contains(names, n)
    only = F.size(names) == 1
    two = F.lit(False) if dual is None else dual
    out = F.when(has("Ha") & has("SII") & has("OIII"), "SHO (Hubble)").when(has("Ha") & has("OIII"), "HOO").when(has("L") & has("R") & has("G") & has("B"), "LRGB").when(has("R") & has("G") & has("B"), "RGB")
    return out.when(two, "Dual Narrowband").when(has("L") & only, "Mono L").when(has("Ha") & only, "Ha only").when(F.size(names) == 0, "Unknown").otherwise("Mixed")


def format_size(size: Column) -> Column:
    k = 1024.0
    big = lambda n, form: F.format_string(form, F.bround(size / k**n, int(form[2])))  # noqa: E731  half to even
    return F.when(size >= k**4, big(4, "%.2f TB")).when(size >= k**3, big(3, "%.2f GB")).when(size >= k**2, big(2, "%.1f MB")).when(size >= k, big(1, "%.0f KB")).otherwise(F.format_string("%d B", size.cast("long")))


def fwhm_grade(fwhm: Column, cuts: tuple[float, float, float]) -> Column:
    """Excellent, Good, Fair or Poor by three rising bounds; N/A for null."""
    return F.when(fwhm.isNull(), "N/A").when(fwhm < cuts[0], "Excellent").when(fwhm < cuts[1], "Good").when(fwhm < cuts[2], "Fair").otherwise("Poor")


def degrees_to_sexagesimal(ra: Column, dec: Column) -> tuple[Column, Column]:
    """('05h 34m 31.97s', '+22d 00m 52.1s'); null outside 0 to 360 and -90 to 90."""
    valid = (ra >= 0) & (ra < 360) & (dec >= -90) & (dec <= 90)
    hours, size = ra.cast("double") / 15, F.abs(dec.cast("double"))
    h, d = F.floor(hours), F.floor(size)
    m, n = F.floor((hours - h) * 60), F.floor((size - d) * 60)
    one = F.format_string("%02dh %02dm %05.2fs", h, m, (hours - h - m / 60) * 3600)
    other = F.format_string("%s%02dd %02dm %04.1fs", F.when(dec >= 0, "+").otherwise("-"), d, n, (size - d - n / 60) * 3600)
    return F.when(valid, one), F.when(valid, other)


def normalize_ra(ra: Column) -> Column:
    """Hours: 24 and more were degrees."""
    return F.when(ra >= 24, ra / 15).otherwise(ra)


def valid_position(ra_hours: Column, dec: Column) -> Column:
    return F.coalesce((ra_hours >= 0) & (ra_hours < 24) & (dec >= -90) & (dec <= 90), F.lit(False))


def decode_json(c: Column, schema: str) -> Column:
    """The value, or null where the text isn't of the schema."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def sanitize(c: Column, most: int = 200) -> Column:
    """A text as part of a file name: no control characters or reserved ones, single spaces, no dots or spaces at its ends."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f]", "")), r"[<>:\"/\\|?*']", "_"), r"\s+", " ")
    return F.substring(F.regexp_replace(plain, r"^[. ]+|[. ]+$", ""), 1, most)


def build_filename(pattern: str, tokens: dict[str, Column], number: Column, extension: str = "") -> Column:
    """``pattern`` with its $$TOKEN$$ places filled, $$FRAMENR$$ by the four-digit number, which is put at the end where the pattern has no place for it."""
    out = F.lit(pattern)
    for token, value in tokens.items():
        if token in pattern:
            out = F.replace(out, F.lit(token), F.coalesce(value.cast("string"), F.lit("")))
    four = F.format_string("%04d", number)
    out = F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("$$FRAMENR$$"), four), "_+", "_"), "^_|_$", "")
    out = out if "$$FRAMENR$$" in pattern else F.concat_ws("_", out, four)
    return sanitize(F.when(out.endswith(extension), out).otherwise(F.concat(out, F.lit(extension))) if extension else out)


def expand_template(template: str, tokens: dict[str, Column]) -> Column:
    """``template`` with its {TOKEN} places filled; each value is made safe for a folder name."""
    out = F.lit(template)
    for token, value in tokens.items():
        out = F.replace(out, F.lit(token), sanitize(value.cast("string")))
    return out


def filter_by_time(ts: Column, ranges: list[tuple[str, str, str]], longitude: float | None = None, zone: str | None = None) -> Column:
    """The filter of the first (start, end, filter) that holds the time of day, in UTC, in local solar time of ``longitude`` or in ``zone``; '' for none.

    Ends are outside; a range may cross midnight, one of no length never holds.
    """
    local = F.from_utc_timestamp(ts, zone) if zone else F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + int((longitude or 0) / 15 * 3_600_000_000))
    minutes = F.hour(local) * 60 + F.minute(local) + F.second(local) / 60
    out = None
    for start, end, name in ranges:
        a, b = (int(x[:2]) * 60 + int(x[3:]) for x in (start, end))
        if a != b:
            inside = (minutes >= a) & (minutes < b) if b > a else (minutes >= a) | (minutes < b)
            out = (F.when if out is None else out.when)(inside, name)
    return F.lit("") if out is None else out.otherwise("")
