"""Mount logs, processing logs and image headers as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sexagesimal_to_degrees
from ..plans.durable import stored
from .headers import read_image_headers
from .lines import following, running, text_lines


def _after(lines: DataFrame, marker: str) -> DataFrame:
    """The lines below each file's first line that starts with ``marker``."""
    heads = lines.where(F.col("line").startswith(marker)).groupBy("source_path").agg(F.min("line_no").alias("head"))
    return lines.join(heads, "source_path").where("line_no > head and trim(line) <> ''").drop("head")


def read_mount_dat(spark: SparkSession, root: str) -> DataFrame:
    """Samples of mount tracking logs: time, position, spreads, axes and status (the last field). Rows that lack a field are left out."""
    cells = _after(text_lines(spark, root, "*.dat"), "RAW Mount time").select("source_path", "line_no", F.split("line", "\t").alias("c"))
    of = lambda k: F.trim(F.get("c", F.lit(k)))
    ra, dec = sexagesimal_to_degrees(of(3)), sexagesimal_to_degrees(of(6))
    rows = cells.where(F.size("c") >= 8).select("source_path", "line_no", of(1).alias("timestamp"), ra.alias("ra_hours"), of(4).try_cast("double").alias("ra_stdev"), dec.alias("dec_degrees"), of(7).try_cast("double").alias("dec_stdev"), of(8).try_cast("double").alias("dec_axis"), of(12).try_cast("double").alias("ra_axis"), F.trim(F.element_at("c", -1)).alias("status"))
    return rows.where("ra_hours is not null and dec_degrees is not null")


def read_mount_dti(spark: SparkSession, root: str) -> DataFrame:
    cells = _after(text_lines(spark, root, "*.dti"), "Mount time").select("source_path", "line_no", F.split("line", "\t").alias("c"))
    names = ("pc_mount_diff_ms", "pc_loop_ms", "mount_loop_ms", "ntp_diff_ms")
    return cells.select("source_path", "line_no", F.trim(F.get("c", F.lit(0))).alias("timestamp"), *(F.trim(F.get("c", F.lit(k + 1))).try_cast("double").alias(n) for k, n in enumerate(names)))


def read_mount_header(spark: SparkSession, root: str) -> DataFrame:
    """version, location, mount and firmware from the first 20 lines of each tracking log."""
    head = text_lines(spark, root, "*.dat").where("line_no < 20")
    cell = lambda name: F.min_by(F.nullif(F.trim(F.regexp_replace("line", rf"^\s*{name}:\s*", "")), F.lit("")), F.when(F.col("line").rlike(rf"^\s*{name}:"), F.col("line_no")))
    version = F.min_by(F.nullif(F.regexp_extract("line", r"\(v\.([\d.]+)\)", 1), F.lit("")), F.when(F.col("line_no") == 0, 0))
    return head.groupBy("source_path").agg(version.alias("version"), cell("Location").alias("location"), cell("Mount").alias("mount"), cell("Firmware").alias("firmware"))


def _cells(spark: SparkSession, root: str, pattern: str, least: int):
    """(lines split at tabs below the line 'Timestamp', getters of a text, a number and a whole number)."""
    cells = _after(text_lines(spark, root, pattern), "Timestamp").select("source_path", "line_no", F.split("line", "\t").alias("c")).where(F.size("c") >= least)
    of = lambda k: F.nullif(F.trim(F.get("c", F.lit(k))), F.lit(""))
    return cells.where(of(0).isNotNull()), of, lambda k: of(k).try_cast("double"), lambda k: of(k).try_cast("double").cast("int")


def read_mount_fft(spark: SparkSession, root: str) -> DataFrame:
    """Periodic-error peaks: axis, sample rate, bins, and frequency, period and amplitude of three peaks."""
    cells, text, number, whole = _cells(spark, root, "*.fft", 13)
    peaks = [number(4 + 3 * p + k).alias(f"peak{p + 1}_{n}") for p in range(3) for k, n in enumerate(("freq", "period", "amp"))]
    return cells.select("source_path", "line_no", text(0).alias("timestamp"), text(1).alias("axis"), number(2).alias("sample_rate"), whole(3).alias("num_bins"), *peaks)


def read_mount_env(spark: SparkSession, root: str) -> DataFrame:
    """Environment samples; any field may be empty."""
    cells, text, number, whole = _cells(spark, root, "*.env", 2)
    named = {"temp_ext": number(1), "pressure": number(2), "temp_int": number(3), "tracking_rate": text(5), "meridian_flip_min": number(6), "pier_side": text(7), "align_stars": whole(8), "align_rms": number(9), "polar_error": number(10)}
    return cells.select("source_path", "line_no", text(0).alias("timestamp"), *(v.alias(k) for k, v in named.items()))


def read_mount_meta(spark: SparkSession, root: str) -> DataFrame:
    """mount and firmware: the first of each in every event log."""
    lines = text_lines(spark, root, "*.log")
    first = lambda form: F.min_by(F.trim(F.regexp_extract("line", form, 1)), F.when(F.col("line").rlike(form), F.col("line_no")))
    return lines.groupBy("source_path").agg(first(r"Mount:\s*(.+?)\s*\|").alias("mount"), first(r"FW:\s*([\d.]+)").alias("firmware"))


def mount_sessions(headers: DataFrame, *companions: tuple[str, DataFrame]) -> DataFrame:
    """One row for each tracking log, with the rows of its companions (name, table): files of the same folder and stem are one session. A companion without
    several rows a file gives its columns, others the number of their rows; the log's mount and firmware fill what the tracking log lacks."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    out = headers.withColumn("session", stem("source_path")).drop("source_path")
    for name, table in companions:
        own = table.withColumn("session", stem("source_path"))
        if "line_no" in table.columns:
            out = out.join(own.groupBy("session").agg(F.count("*").alias(f"n_{name}")), "session", "left").fillna(0, [f"n_{name}"])
        else:
            values = [c for c in table.columns if c != "source_path"]
            out = out.join(own.select("session", *(F.col(c).alias(f"_{c}") for c in values)), "session", "left")
            out = out.withColumns({c: F.coalesce(c, f"_{c}") if c in out.columns else F.col(f"_{c}") for c in values}).drop(*(f"_{c}" for c in values))
    return out


def read_xisf_headers(spark: SparkSession, root: str, pattern: str = "*.xisf") -> DataFrame:
    """(path, place, keyword, value, compression) of the keyword elements in the XML at the start of each file, whose length the file's bytes 9 to 12 say; the codec is the image element's."""
    files = read_image_headers(spark, root, "xisf", pattern)
    xml = files.where(F.size("headers") == 1).select("path", F.decode(F.get("headers", F.lit(0)), "UTF-8").alias("xml"))
    plain = xml.withColumn("xml", F.regexp_replace(F.regexp_replace("xml", r"\x00", ""), r"<\?xml[^>]*\?>", ""))
    found = plain.select("path", F.expr("xpath(xml, '//FITSKeyword/@name')").alias("k"), F.expr("xpath(xml, '//FITSKeyword/@value')").alias("v"), F.nullif(F.expr("xpath_string(xml, '//Image/@compression')"), F.lit("")).alias("compression"))
    pairs = found.select("path", "compression", F.posexplode_outer(F.arrays_zip("k", "v")).alias("place", "p"))
    return pairs.select("path", "place", F.col("p.k").alias("keyword"), F.trim(F.regexp_replace("p.v", "^'(.*?)\\s*'$", "$1")).alias("value"), "compression")


def extension_mismatches(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, content): files whose first bytes are of another kind than their ending. FITS begins with SIMPLE, XISF with XISF0100; .fz holds FITS."""
    files = read_image_headers(spark, root, "magic")
    name = F.lower("path")
    ending = F.when(name.rlike(r"\.(fits|fit)\.fz$"), "fz").when(name.rlike(r"\.(fits|fit|fts)$"), "fits").when(name.endswith(".xisf"), "xisf").otherwise("unknown")
    start = F.decode("magic", "ISO-8859-1")
    kind = F.when(start == "XISF0100", "xisf").when(start.startswith("SIMPLE"), "fits").otherwise("unknown")
    judged = files.select("path", ending.alias("extension"), kind.alias("content")).where("extension <> 'unknown'")
    return judged.where(F.when(F.col("extension") == "fz", "fits").otherwise(F.col("extension")) != F.col("content"))


def read_processing_log(spark: SparkSession, root: str, product: str, pattern: str = "*.log") -> DataFrame:
    """(source_path, line_no, logged_at, line) of the logs that name ``product`` in their first 1,024 characters; the ``[time]`` prefix is taken off.

    A log is read by as many tasks as it has splits. The numbered lines are kept in the checkpoint folder, as many parsers go over them.
    """
    lines = stored(text_lines(spark, root, pattern))
    start = lines.where("line_no < 1024").groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.substring("line", 1, 1024).alias("line")))).alias("first"))
    named = start.where(F.substring(F.array_join("first.line", "\n"), 1, 1024).contains(product))
    stamp = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] ?"
    kept = lines.join(named.select("source_path"), "source_path", "left_semi")
    return kept.select("source_path", "line_no", F.try_to_timestamp(F.regexp_extract("line", stamp, 1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("logged_at"), F.regexp_replace("line", stamp, "").alias("line"))


def subframe_metrics(lines: DataFrame) -> DataFrame:
    """Blocks of a file name, a line of dashes and ``Key : value`` lines, as (source_path, block, file, key, value). ``lines`` are all lines of each log."""
    dashes, pair = r"^\s*-{5,}\s*$", r"^[^:]+ : "
    starts = F.coalesce(F.col("_one").rlike(dashes) & F.col("_two").rlike(pair) & ~F.col("line").rlike(dashes), F.lit(False))
    head = F.when(starts, F.struct("line_no", F.trim("line").alias("file")))
    stop = F.when(F.col("line").rlike(dashes) | (F.trim("line") == ""), F.col("line_no"))
    body = running(following(lines, {"_one": 1, "_two": 2}), {"block": starts}, {"begun": head, "ended": stop})
    place = F.col("line_no") - F.col("begun.line_no")  # the line of dashes, at place 1, doesn't end a block
    kept = body.where((place > 1) & (F.coalesce("ended", F.lit(-1)) < F.col("begun.line_no") + 2) & F.col("line").rlike(pair))
    return kept.select("source_path", "block", F.col("begun.file").alias("file"), F.trim(F.regexp_extract("line", r"^([^:]+?)\s* : ", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]+ : (.*)$", 1)).alias("value"))


def calibration_groups(lines: DataFrame, reach: int = 20) -> DataFrame:
    """A row for each 'Group of N <type> frames (M active)': numbers, and of the up to ``reach`` lines below it (ended by a blank line, by *** or by the next group) size, binning,
    filter, exposure (seconds, or the range as written), keywords, colour mode, master paths and pedestal."""
    found = r"^\s*Group of (\d+) (\w+) frames?\s*\((\d+) active\)"
    is_start = F.col("line").rlike(found)
    stop = F.when((F.trim("line") == "") | F.trim("line").startswith("***"), F.col("line_no"))
    marked = running(lines, {"block": is_start}, {"begun": F.when(is_start, F.col("line_no")), "ended": stop})
    body = marked.where((F.col("line_no") - F.col("begun") < reach) & (F.coalesce("ended", F.lit(-1)) < F.col("begun")))

    def part(form: str, k: int = 1):
        return F.min_by(F.trim(F.regexp_extract(F.trim("line"), form, k)), F.when(F.trim("line").rlike(form), F.col("line_no")))

    master = lambda kind: F.nullif(part(rf"^Master {kind}:\s*(.+)"), F.lit("none")).alias(f"master_{kind}")
    exposure = part(r"^Exposure\s*:\s*\[?([^\]]+)\]?")
    out = body.groupBy("source_path", "block").agg(
        F.min("line_no").alias("line_no"), part(found).cast("int").alias("n_frames"), part(found, 2).alias("frame_type"), part(found, 3).cast("int").alias("n_active"), part(r"^SIZE\s*:\s*(\d+)x(\d+)").cast("int").alias("width"), part(r"^SIZE\s*:\s*(\d+)x(\d+)", 2).cast("int").alias("height"),
        part(r"^BINNING\s*:\s*(\d+)").cast("int").alias("binning"), part(r"^Filter\s*:\s*(\S+)").alias("filter_name"), exposure.alias("exposure"), part(r"^Keywords\s*:\s*\[(.*)\]").alias("keywords"), part(r"^Color\s*:\s*(\S+)").alias("color_mode"), *(master(k) for k in ("bias", "dark", "flat")),
        part(r"^Applying automatic pedestal:\s*([\d.]+)").cast("double").alias("pedestal"),
    )
    seconds = F.regexp_replace("exposure", "s$", "").try_cast("double")
    return out.withColumn("exposure_seconds", seconds).withColumn("exposure_range", F.when(seconds.isNull(), F.col("exposure"))).drop("exposure")


def frame_rejections(lines: DataFrame) -> DataFrame:
    """(source_path, line_no, filename, weight, threshold, accepted) of both kinds of rejection lines; a warning has no threshold."""
    plain = r"^\[Frames rejection\]\s*(.+?)\s*-\s*([\d.]+)\s*[<>]?\s*([\d.]+)\s*\|\s*(\w+)"
    warning = r"^\*{3}\s*Warning:\s*frame rejected\s*\[(.+?)\s*-\s*([\d.]+)"
    of = lambda form, k: F.regexp_extract("line", form, k)
    one = lines.where(F.col("line").rlike(plain)).select("source_path", "line_no", F.trim(of(plain, 1)).alias("filename"), of(plain, 2).try_cast("double").alias("weight"), of(plain, 3).try_cast("double").alias("threshold"), (F.lower(of(plain, 4)) == "accepted").alias("accepted"))
    other = lines.where(F.col("line").rlike(warning)).select("source_path", "line_no", F.trim(of(warning, 1)).alias("filename"), of(warning, 2).try_cast("double").alias("weight"), F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("accepted"))
    return one.unionByName(other)


def integration_lines(lines: DataFrame) -> DataFrame:
    """The lines between '* Begin integration of Light frames' and its end, with integration (from 1 in each log) and the next line."""
    begins, ends = F.col("line").contains("* Begin integration of Light frames"), F.col("line").contains("* End integration of Light frames")
    marked = running(following(lines, {"next": 1}), {"integration": begins}, {"open": F.when(begins, True).when(ends, False)})
    return marked.where("open").withColumns({"line": F.trim("line"), "next": F.trim("next")}).drop("open")


def integrations(lines: DataFrame) -> DataFrame:
    """One row for each integration of light frames: filter, frames in all, integrated and rejected, methods, rejection percentages, output estimates and file."""
    body = integration_lines(lines)

    def part(form: str, k: int = 1, last: bool = False):
        return (F.max_by if last else F.min_by)(F.trim(F.regexp_extract("line", form, k)), F.when(F.col("line").rlike(form), F.col("line_no")))

    total = r"^Total\s*:\s*\d+\s+([\d.]+)%\s*\(\s*\d+\s*\+\s*\d+\s*=\s*([\d.]+)%\s*\+\s*([\d.]+)%\)"
    number = lambda name: part(rf"^{name}\s*:\s*([eE\d.+-]+)", last=True).try_cast("double")
    out = body.groupBy("source_path", "integration").agg(
        part(r"^Filter\s*:\s*(\S+)").alias("filter_name"), part(r"^Group of (\d+) Light frames?\s*\(\d+ active\)").cast("int").alias("frames_total"), part(r"^Integration of (\d+) images?:", last=True).cast("int").alias("frames_integrated"),
        part(r"^Pixel combination\s*\.+\s*(.+)", last=True).alias("combination_method"), part(r"^Weighting mode\s*\.+\s*(.+)", last=True).alias("weight_mode"), part(r"^Output normalization\s*\.+\s*(.+)", last=True).alias("normalization"),
        F.coalesce(part(r"^Pixel rejection\s*\.+\s*(.+)", last=True), part(r"^Rejection method auto-selected:\s*(.+)")).alias("rejection_method"), *(part(total, k, True).cast("double").alias(n) for k, n in ((1, "total_rejection_pct"), (2, "low_rejection_pct"), (3, "high_rejection_pct"))),
        number("SNR estimates").alias("output_snr"), number("PSF signal weights").alias("output_psf_signal"), number("Noise estimates").alias("output_noise"), F.max_by("next", F.when(F.col("line").contains("* Writing master Light frame:"), F.col("line_no"))).alias("output_file"),
    )
    rejected = F.when((F.col("frames_total") > 0) & (F.col("frames_integrated") > 0), F.col("frames_total") - F.col("frames_integrated"))
    return out.withColumn("frames_rejected", rejected).where("frames_integrated > 0 or filter_name is not null")


def integration_weights(lines: DataFrame) -> DataFrame:
    """(source_path, integration, line_no, filename, normalized_weight): '[ n ] path' lines of a list of normalised weights, with the number on the next line."""
    body = integration_lines(lines)
    begins = F.col("line").contains("* Begin integration of Light frames")
    state = F.when(F.col("line").contains("Normalized image weights:"), True).when(begins | (F.col("line") == "") | F.col("line").startswith("Integration of") | F.col("line").startswith("* Available"), False)
    listed = running(body, lasts={"inside": state}).where("inside")
    form = r"^\[\s*\d+\]\s*(.+)"
    return listed.where(F.col("line").rlike(form)).select("source_path", "integration", "line_no", F.trim(F.regexp_extract("line", form, 1)).alias("filename"), F.col("next").try_cast("double").alias("normalized_weight"))


def pixel_rejections(lines: DataFrame) -> DataFrame:
    """(source_path, integration, line_no, filename, pixel_rejection_count, ..pct, low.., high..): a file's line and its numbers on the next line."""
    form = r"^\d+\s*:\s*(\d+)\s+([\d.]+)%\s*\(\s*(\d+)\s*\+\s*(\d+)\s*=\s*([\d.]+)%\s*\+\s*([\d.]+)%\)"
    body = integration_lines(lines).where(F.col("next").rlike(form) & ~F.col("line").rlike(r"^(\d|\[|\*|Total|Computing|PSF)") & (F.col("line") != "") & ~F.col("line").contains("Pixel rejection counts"))
    of = lambda k: F.regexp_extract("next", form, k)
    return body.select("source_path", "integration", "line_no", F.col("line").alias("filename"), of(1).cast("long").alias("pixel_rejection_count"), of(2).cast("double").alias("pixel_rejection_pct"), of(5).cast("double").alias("low_rejection_pct"), of(6).cast("double").alias("high_rejection_pct"))


def log_summary(lines: DataFrame, head: int = 30) -> DataFrame:
    """By log: first time, tool and script versions (of the first ``head`` lines), registration totals and the last elapsed time."""
    tool, script = r"^\S+ Core\s+([\d.]+\s+\S+)", r"^(Weighted Batch Preprocessing Script|Fast Batch Preprocessing)\s+([\d.]+)"
    aligned, elapsed = r"^=+\s*StarAlignment:\s*(\d+)\s*succeeded,\s*(\d+)\s*failed,\s*(\d+)\s*skipped", r"^\s*\*\s*(?:WeightedBatchPreprocessing|FastBatchPreprocessing):\s*(.+)"
    early = lambda form, k: F.max_by(F.trim(F.regexp_extract("line", form, k)), F.when(F.col("line").rlike(form) & (F.col("line_no") < head), F.col("line_no")))
    total = lambda k: F.coalesce(F.sum(F.regexp_extract("line", aligned, k).try_cast("long")), F.lit(0))
    return lines.groupBy("source_path").agg(
        F.min_by("logged_at", F.when(F.col("logged_at").isNotNull(), F.col("line_no"))).alias("log_timestamp"), early(tool, 1).alias("tool_version"), early(script, 1).alias("script_name"), early(script, 2).alias("script_version"),
        total(1).alias("registration_succeeded"), total(2).alias("registration_failed"), total(3).alias("registration_skipped"), F.max_by(F.trim(F.regexp_extract("line", elapsed, 1)), F.when(F.col("line").rlike(elapsed), F.col("line_no"))).alias("total_elapsed"),
    )


def parse_light_filename(files: DataFrame, column: str) -> DataFrame:
    """Adds target, filter, binning, exposure, temperature, camera and sequence from names like LIGHT_<target>_<date>_<time>_<filter>_...; null where a name is of another form."""
    form = r"LIGHT_(.+?)_(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})_([^_]+)_(\d+x\d+)_([\d.]+)s_([^_]+)_(-?[\d.]+)_([^_]+)_(\d+)"
    part = lambda k: F.nullif(F.regexp_extract(column, form, k), F.lit(""))
    return files.withColumns({"target": part(1), "night": part(2).try_cast("date"), "filter": part(4), "binning": part(5), "exposure": part(6).try_cast("double"), "temperature": part(8).try_cast("double"), "camera": part(9), "sequence": part(10).try_cast("int")})


def read_fits_headers(spark: SparkSession, root: str, pattern: str = "*.{fits,fit,fts,fits.fz,fit.fz}") -> DataFrame:
    """(path, place, keyword, value) of the 80-character cards up to END.

    A compressed file's cards are those of its first extension, and of its own first header the keywords that the extension lacks. Only headers are read of the files.
    """
    files = read_image_headers(spark, root, "fits", pattern).where(F.size("headers") > 0)

    def cards(header: Column) -> Column:
        """The cards that have a value, before END; those of a header one after the other."""
        every = F.transform(F.sequence(F.lit(0), F.floor(F.length(header) / 80).cast("int") - 1), lambda i: F.decode(F.substring(header, i * 80 + 1, F.lit(80)), "ISO-8859-1"))
        whole = F.slice(every, 1, F.array_position(F.transform(every, lambda c: F.trim(c) == "END"), True).cast("int") - 1)
        return F.filter(whole, lambda c: F.substring(c, 9, 1) == "=")

    keyword = lambda c: F.trim(F.substring(c, 1, 8))
    own = files.select("path", cards(F.get("headers", F.lit(0))).alias("a"), F.when(F.size("headers") > 1, cards(F.get("headers", F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("b"))
    known = own.withColumn("known", F.transform("b", keyword))
    merged = known.select("path", F.posexplode(F.concat(F.filter("a", lambda c: ~F.array_contains("known", keyword(c))), "b")).alias("place", "card"))
    value = F.coalesce(F.nullif(F.regexp_extract("card", r"^.{8}= *'((?:[^']|'')*)'", 1), F.lit("")), F.trim(F.regexp_extract("card", r"^.{8}= *([^/]*)", 1)))
    return merged.select("path", "place", keyword(F.col("card")).alias("keyword"), F.trim(value).alias("value"))
