"""Logs read by several tasks give the rows that one task gives, and the rows of a plain walk over the lines."""

import random
import re

import pytest

from nightledger.sources import lines as log_lines
from nightledger.sources import logs
from tests.test_logs import LOG
from tests.test_sources import write

SUBFRAMES = "[2024-01-02 03:04:06] frame_{}.xisf\n----------\nFWHM : 2.{}\nSNR   : 12\nnote\nWeight : 0.{}\n{}\n"
CLOSES = ["----------", "", "frame_x.xisf"]


def made(seed: int, sections: int) -> str:
    """A log of shuffled sections, some of them cut, with long stretches between them."""
    pick = random.Random(seed)
    out = ["[2024-01-02 03:04:05] Tool Core 1.9.3 Lockhart (x64)", "about the Product"]
    for k in range(sections):
        text = LOG if pick.random() < 0.5 else SUBFRAMES.format(k, k, k, pick.choice(CLOSES))
        rows = text.split("\n")
        out += rows[: pick.randrange(3, len(rows))] if pick.random() < 0.3 else rows
        out += [f"some line {j}" for j in range(pick.randrange(40))]
    return "\n".join(out)


@pytest.fixture
def split_small(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "1000")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_lines_of_many_splits_are_numbered_in_order(spark, tmp_path, split_small):
    texts = {"a.log": made(1, 20), "b.log": "one\r\ntwo\r\n\r\nfour", "c.log": "", "d.log": "é" * 3000 + "\n" + "x" * 2500 + "\nlast\n"}
    for name, text in texts.items():
        write(tmp_path / name, text)
    read = log_lines.text_lines(spark, str(tmp_path), "*.log")
    got = {}
    for r in read.collect():
        got.setdefault(r.source_path.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    want = {name: list(enumerate(re.sub(r"\r?\n\Z", "", text).split("\n"))) for name, text in texts.items() if text}
    want = {name: [(k, x.rstrip("\r")) for k, x in rows] for name, rows in want.items()}
    assert {name: sorted(rows) for name, rows in got.items()} == want
    tasks = spark.read.text(str(tmp_path / "a.log"), lineSep="\n").rdd.getNumPartitions()
    assert tasks >= 5


def walked_subframes(text: str) -> list[tuple]:
    rows = [re.sub(r"^\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] ?", "", x) for x in text.split("\n")]
    dashes, pair = re.compile(r"^\s*-{5,}\s*$"), re.compile(r"^[^:]+ : ")
    out, block, file, since = [], 0, None, 0
    for k, line in enumerate(rows):
        if not dashes.match(line) and k + 2 < len(rows) and dashes.match(rows[k + 1]) and pair.match(rows[k + 2]):
            block, file, since = block + 1, line.strip(" "), k
        elif file is not None and k - since > 1:
            if dashes.match(line) or line.strip(" ") == "":
                file = None
            elif pair.match(line):
                key, value = line.split(" : ", 1)
                out.append((block, file, key.strip(), value.strip()))
    return out


def walked_weights(text: str) -> list[tuple]:
    rows = [x.strip(" ") for x in text.split("\n")]
    out, number, is_open, listed = [], 0, False, False
    for k, line in enumerate(rows):
        if "* Begin integration of Light frames" in line:
            number, is_open, listed = number + 1, True, False
        elif "* End integration of Light frames" in line:
            is_open = False
        elif is_open and "Normalized image weights:" in line:
            listed = True
        elif is_open and (line == "" or line.startswith(("Integration of", "* Available"))):
            listed = False
        elif is_open and listed and (found := re.match(r"^\[\s*\d+\]\s*(.+)", line)):
            try:
                weight = float(rows[k + 1])
            except (ValueError, IndexError):
                weight = None
            out.append((number, k, found.group(1), weight))
    return out


def walked_groups(text: str, reach: int = 20) -> list[tuple]:
    rows = text.split("\n")
    starts = [k for k, x in enumerate(rows) if re.match(r"^\s*Group of (\d+) (\w+) frames?\s*\((\d+) active\)", x)]
    out = []
    for number, k in enumerate(starts, 1):
        body = []
        for line in rows[k + 1 : k + reach]:
            if line.strip(" ") == "" or line.strip(" ").startswith("***") or line in (rows[j] for j in starts):
                break
            body.append(line)
        filters = [m.group(1) for x in body if (m := re.match(r"^Filter\s*:\s*(\S+)", x.strip(" ")))]
        out.append((number, k, filters[0] if filters else None))
    return out


def test_sections_over_pieces_and_splits(spark, tmp_path, split_small, monkeypatch):
    texts = {"a.log": made(2, 25), "b.log": made(3, 12)}
    for name, text in texts.items():
        write(tmp_path / name, text)
    monkeypatch.setattr(log_lines, "PIECE", 7)
    lines = logs.read_processing_log(spark, str(tmp_path), "Product")
    of = lambda rows, name: sorted(tuple(r)[1:] for r in rows if r.source_path.endswith(name))
    frames = logs.subframe_metrics(lines).select("source_path", "block", "file", "key", "value").collect()
    weights = logs.integration_weights(lines).select("source_path", "integration", "line_no", "filename", "normalized_weight").collect()
    groups = logs.calibration_groups(lines).select("source_path", "block", "line_no", "filter_name").collect()
    for name, text in texts.items():
        assert of(frames, name) == sorted(walked_subframes(text)) and of(frames, name)
        assert of(weights, name) == sorted(walked_weights(text)) and of(weights, name)
        assert of(groups, name) == walked_groups(text) and of(groups, name)
    parsers = (logs.integrations, logs.pixel_rejections)
    small = [sorted(map(str, p(lines).collect())) for p in parsers]
    monkeypatch.setattr(log_lines, "PIECE", 1 << 30)
    assert [sorted(map(str, p(lines).collect())) for p in parsers] == small and all(small)


def test_no_task_holds_a_file(spark, tmp_path, monkeypatch):
    """Windows are by piece: of a log of 3,000 lines no window group has more than a piece and the lines sent ahead."""
    write(tmp_path / "a.log", "about the Product\n" + "\n".join(f"Key : {k}" for k in range(3000)))
    monkeypatch.setattr(log_lines, "PIECE", 100)
    lines = logs.read_processing_log(spark, str(tmp_path), "Product")
    for parsed in (logs.subframe_metrics(lines), logs.integration_weights(lines), logs.calibration_groups(lines)):
        plan = parsed._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.split("\n") if "Window [" in x]
        assert windows and all("_piece" in x for x in windows)
