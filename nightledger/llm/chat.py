"""Chat formatting: roles of transcript lines by a hidden Markov model, and canonical turns.

A transcript is a sequence of lines, some of which begin with a speaker marker. Hidden states are role x (begins a turn,
continues it); a line shows its marker, its length and whether it asks. The most probable states are found by Viterbi.
Transcripts are range-partitioned by their order, so one of any length spreads over tasks: each task reduces its stretch of a
divided transcript to a max-plus matrix, the matrices (one for each task) are chained, and each task then decodes its
stretch between the states that the chain gives it. The result is that of one pass over the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role + (0 begins a turn, 1 continues it)
# Markers by the role they speak for. Matched at a line's start without regard to case, a colon or space after.
MARKERS = {
    "system": ("system", "### system", "<|system|>", "[system]", "instructions"),
    "user": ("user", "human", "### human", "<|user|>", "[user]", "q", "customer"),
    "assistant": ("assistant", "ai", "bot", "### assistant", "<|assistant|>", "[assistant]", "a"),
}
LENGTHS = (40, 120, 240, 480)  # upper bounds of the length classes
_LINE = "conv_id long, turn long, line int, role string, text string, part int"


def marker_pattern(role: str) -> str:
    escaped = sorted(("".join(c if c.isalnum() or c in " <>#" else "\\" + c for c in m) for m in MARKERS[role]), key=len, reverse=True)
    return r"(?i)^\s*(?:" + "|".join(m if m[-1] == ">" or m.endswith("\\]") else f"{m}\\s*:" for m in escaped) + r")[ \t]*"


def features(lines: DataFrame) -> DataFrame:
    """Adds seen (marker class 0 none, 1.. the role, times length class and question) and body (the line without its marker)."""
    kind, body = F.lit(0), F.col("text")
    for k, role in enumerate(ROLES):
        hit = F.col("text").rlike(marker_pattern(role))
        kind = F.when(hit & (kind == 0), k + 1).otherwise(kind)
        body = F.when(hit, F.regexp_replace("text", marker_pattern(role), "")).otherwise(body)
    size = sum((F.when(F.length("body") > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    asks = F.when(F.rtrim("body").endswith("?"), 1).otherwise(0)
    out = lines.withColumn("kind", kind).withColumn("body", body)
    return out.withColumn("seen", ((F.col("kind") * (len(LENGTHS) + 1) + size) * 2 + asks).cast("int")).drop("kind")


SEEN = (len(ROLES) + 1) * (len(LENGTHS) + 1) * 2


@dataclass
class Hmm:
    """Log probabilities of first states, transitions and what is seen."""

    first: np.ndarray
    step: np.ndarray
    shows: np.ndarray

    @classmethod
    def fitted(cls, labelled: DataFrame, smooth: float = 0.5) -> Hmm:
        """Counts over all rows of ``labelled`` (conv_id, turn, line, role, text), with the impossible steps left out.

        States follow from the row itself, and so does the state before a line but for a turn's first line, whose
        predecessor is the role of the turn before: role changes are counted between rows whose turns follow one another.
        """
        roles = F.create_map(*[x for k, r in enumerate(ROLES) for x in (F.lit(r), F.lit(k))])
        lines = features(labelled).withColumn("r", roles[F.col("role")]).where("r is not null")
        state = (2 * F.col("r") + F.when(F.col("line") > 0, 1).otherwise(0)).alias("state")
        seen = np.zeros((STATES, len(ROLES) + 1, len(LENGTHS) + 1, 2))
        for r in lines.groupBy(state, "seen").count().collect():
            seen.reshape(STATES, SEEN)[r["state"], r["seen"]] += r["count"]
        # given the state, marker, length and question are taken as independent, each with counts of its own
        shares = [m / m.sum(axis=1, keepdims=True) for m in (seen.sum(axis=axes) + smooth for axes in ((2, 3), (1, 3), (1, 2)))]
        shows = (shares[0][:, :, None, None] * shares[1][:, None, :, None] * shares[2][:, None, None, :]).reshape(STATES, SEEN)
        turns = lines.where("line = 0").groupBy("conv_id", "turn").agg(F.min("r").alias("r"))
        first, change = np.full(STATES, 1e-6), np.full((len(ROLES), len(ROLES)), smooth)
        first[::2] = smooth
        for r in turns.where("turn = 0").groupBy("r").count().collect():
            first[2 * r["r"]] += r["count"]
        following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
        for r in turns.join(following, ["conv_id", "turn"]).groupBy("r", "next").count().collect():
            change[r["r"], r["next"]] += r["count"]
        starts, more = np.full(len(ROLES), smooth), np.full(len(ROLES), smooth)
        for r in lines.groupBy("r", (F.col("line") > 0).alias("more")).count().collect():
            (more if r["more"] else starts)[r["r"]] += r["count"]
        stay = more / (more + starts)  # a line is followed by another of its turn
        step = np.full((STATES, STATES), 1e-12)
        for a in range(len(ROLES)):
            for inside in (0, 1):
                step[2 * a + inside, 2 * a + 1] = stay[a]
                step[2 * a + inside, ::2] = (1 - stay[a]) * change[a] / change[a].sum()
        return cls(np.log(first / first.sum()), np.log(step / step.sum(axis=1, keepdims=True)), np.log(shows / shows.sum(axis=1, keepdims=True)))

    def stretch(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best score to each last state from a start here, the same from each state before) of a stretch of lines."""
        start = self.first + self.shows[:, seen[0]]
        inner = self.step + self.shows[:, seen[0]]
        for s in seen[1:]:
            start = (start[:, None] + self.step).max(axis=0) + self.shows[:, s]
            inner = (inner[:, :, None] + self.step[None]).max(axis=1) + self.shows[:, s]
        return start, inner

    def decode(self, seen: np.ndarray, entry: int = -1, leave: int = -1) -> np.ndarray:
        """Best states, given the state before (-1: a start) and the last state (-1: any)."""
        best = (self.first if entry < 0 else self.step[entry]) + self.shows[:, seen[0]]
        back = np.zeros((len(seen), STATES), np.int8)
        for k in range(1, len(seen)):
            through = best[:, None] + self.step
            back[k] = through.argmax(axis=0)
            best = through.max(axis=0) + self.shows[:, seen[k]]
        out = np.empty(len(seen), np.int64)
        out[-1] = best.argmax() if leave < 0 else leave
        for k in range(len(seen) - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out


def _stretches(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int | None, list[list]]]:
    """(conv_id, columns) of each run of one transcript in a sorted partition."""
    at, held, any_row = None, [[] for _ in columns], False
    for batch in batches:
        for key, *values in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *columns))):
            if any_row and key != at:
                yield at, held
                held = [[] for _ in columns]
            at, any_row = key, True
            for column, value in zip(held, values):
                column.append(value)
    if any_row:
        yield at, held


def _reduce(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (part, seen) in _stretches(batches, ["part", "seen"]):
            start, inner = model.value.stretch(np.array(seen))
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([key], pa.int64()), "part": pa.array([part[0]], pa.int32()), "start": [start.tolist()], "inner": [inner.ravel().tolist()]})

    return run


def _chain(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    forward = [np.array(rows[0]["start"])]
    for r in rows[1:]:
        forward.append((forward[-1][:, None] + np.array(r["inner"]).reshape(STATES, STATES)).max(axis=0))
    leave, entry = [int(forward[-1].argmax())], []
    for k in range(len(rows) - 1, 0, -1):
        entry.append(int((forward[k - 1] + np.array(rows[k]["inner"]).reshape(STATES, STATES)[:, leave[-1]]).argmax()))
        leave.append(entry[-1])
    entry = [-1, *reversed(entry)]
    n = len(rows)
    return pa.table({"conv_id": table.column("conv_id"), "part": pa.array([r["part"] for r in rows], pa.int32()), "entry": pa.array(entry, pa.int32()), "leave": pa.array(leave[::-1], pa.int32()), "ends": [k == n - 1 for k in range(n)]})


def _decode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (turn, line, truth, seen, body, entry, leave, ends) in _stretches(batches, ["turn", "line", "role", "seen", "body", "entry", "leave", "ends"]):
            opens = entry[0] is None or entry[0] < 0
            closes = ends[0] is None or ends[0]
            states = model.value.decode(np.array(seen), -1 if opens else entry[0], -1 if leave[0] is None else leave[0])
            role = [ROLES[s // 2] for s in states]
            begins = [s % 2 == 0 or (opens and k == 0) for k, s in enumerate(states)]
            shown = [("" if opens and k == 0 else "<|end|>\n") + f"<|{r}|>\n{b}\n" if new else f"{b}\n" for k, (r, new, b) in enumerate(zip(role, begins, body))]
            if closes:
                shown[-1] += "<|end|>\n"
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([key] * len(seen), pa.int64()), "turn": pa.array(turn, pa.int64()), "line": pa.array(line, pa.int32()), "true_role": pa.array(truth, pa.string()), "role": role, "begins_turn": begins, "rendered": shown})

    return run


def parse_transcripts(lines: DataFrame, model: Hmm) -> DataFrame:
    """Roles and canonical rendering of ``lines`` (conv_id, turn, line, role, text), which are in the order of turn, line.

    The given role isn't used; it is handed on as true_role. Returns conv_id, turn, line, true_role, role, begins_turn and
    rendered; a transcript's rendered lines, joined in order, are its canonical turns: ``<|role|>``, the lines without their
    markers, ``<|end|>``. Null text is an empty line; null turns come first; lines of a null conv_id are one transcript;
    repeated rows are lines of their own; an empty table gives an empty result.
    """
    known = lines.sparkSession.sparkContext.broadcast(model)
    rows = features(lines.withColumn("text", F.coalesce("text", F.lit(""))))
    rows = rows.repartitionByRange("conv_id", "turn", "line", "text").sortWithinPartitions("conv_id", "turn", "line", "text")
    rows = durable(rows.withColumn("part", F.spark_partition_id()))  # what a partition holds is fixed by now
    reach = rows.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select(F.col("conv_id").alias("divided"))
    split = rows.join(F.broadcast(reach), F.col("conv_id").eqNullSafe(F.col("divided")), "left_semi")  # two for each partition at most
    matrices = split.select("conv_id", "part", "seen").mapInArrow(_reduce(known), "conv_id long, part int, start array<double>, inner array<double>")
    chained = matrices.groupBy("conv_id").applyInArrow(_chain, "conv_id long, part int, entry int, leave int, ends boolean").withColumnsRenamed({"conv_id": "divided", "part": "at"})
    joined = rows.join(F.broadcast(chained), F.col("conv_id").eqNullSafe(F.col("divided")) & (F.col("part") == F.col("at")), "left")
    return joined.select("conv_id", "turn", "line", "role", "seen", "body", "entry", "leave", "ends").mapInArrow(_decode(known), "conv_id long, turn long, line int, true_role string, role string, begins_turn boolean, rendered string")


def as_lines(conversations: DataFrame, missing: float = 0.3) -> DataFrame:
    """Conversations as raw transcript lines: turns cut at newlines, with the markers of one of four styles.

    A share ``missing`` of the markers, chosen by a hash of the row, is left out, and one conversation in five has none at all.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    style = F.pmod(F.xxhash64("conv_id", F.lit(21)), F.lit(5))
    names = {"system": ("System: ", "### System: ", "[system] ", "Instructions: "), "user": ("User: ", "### Human: ", "[user] ", "Q: "), "assistant": ("Assistant: ", "### Assistant: ", "[assistant] ", "A: ")}
    by_role = [F.when(F.col("role") == r, F.element_at(F.array(*map(F.lit, n)), (style + 1).cast("int"))) for r, n in names.items()]
    marked = (style < 4) & (F.pmod(F.xxhash64("conv_id", "turn", F.lit(22)), F.lit(1000)) >= int(1000 * missing))
    marker = F.when(marked, F.coalesce(*by_role, F.lit(""))).otherwise("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), marker.alias("marker"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return rows.select("conv_id", "turn", "line", "role", F.when(F.col("line") == 0, F.concat("marker", "text")).otherwise(F.col("text")).alias("text"))


def digest(conversations: DataFrame) -> DataFrame:
    """Every conversation as a raw transcript, its roles recovered by a model fitted on those whose crc32(conv_id) mod 3 is not 1."""
    lines = as_lines(conversations)
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 3 == 1, F.lit(False))
    found = parse_transcripts(lines, Hmm.fitted(lines.where(~held_out)))
    return found.withColumn("held_out", held_out)
