"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines.

The hidden state of a line is a role and whether the line opens a turn; what is
seen is its speaker marker (none, a known one, another one) and the kind of line.
Probabilities are counted on labelled conversations.  Viterbi runs in segments:
each segment gives the best score from every entering to every leaving state, the
segments of a conversation are chained by these small matrices, and each is then
decoded for its own ends.  So the result is that of one pass over the whole
transcript, however long.  Recovered turns are rendered in one canonical form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.shared import table, written

ROLES = ("system", "user", "assistant")
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
TURNS_PER_SEGMENT = 200
MARKER = re.compile(r"^\s*(?:<\|([A-Za-z]{1,20})\|>|\[([A-Za-z]{1,20})\]:?|\*\*([A-Za-z]{1,20})\s*:?\*\*:?|(?:#+\s*|>+\s*)?([A-Za-z]{1,20})\s*:)(?: |$)")
# ways in which transcripts mark speakers, in the order of ROLES
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("SYSTEM: ", "Human: ", "AI: "),
    ("### System: ", "### Instruction: ", "### Response: "),
    ("<|system|> ", "<|user|> ", "<|assistant|> "),
    ("[Context] ", "[Q] ", "[A] "),
    ("**Setup:** ", "**Customer:** ", "**Agent:** "),
)


def marker(line: str) -> tuple[str, int]:
    """The speaker marker's name in lower case ('' without one) and its length in the line."""
    found = MARKER.match(line)
    return (found[found.lastindex].lower(), found.end()) if found else ("", 0)


def kind(line: str) -> int:
    """Kinds of line: blank, question, list or table or code, short, other."""
    bare = line.strip()
    if not bare:
        return 0
    if bare.endswith("?"):
        return 1
    if bare[0] in "-*|`" or bare[0].isdigit():
        return 2
    return 3 if len(bare) < 60 else 4


@dataclass
class Model:
    """Log probabilities: start and transition of states, marker (last: unknown) and kind per state."""

    markers: dict[str, int]
    start: np.ndarray
    step: np.ndarray
    sees_marker: np.ndarray
    sees_kind: np.ndarray

    def scores(self, lines: list[str]) -> np.ndarray:
        seen = [marker(x)[0] for x in lines]
        at = [self.markers.get(m, len(self.markers)) for m in seen]
        return self.sees_marker[:, at].T + self.sees_kind[:, [kind(x) for x in lines]].T

    def through(self, lines: list[str]) -> np.ndarray:
        """Best score from the state before the first line (last row: from the start) to the state of the last one."""
        best, entered = None, np.vstack([self.step, self.start])
        for score in self.scores(lines):
            best = entered + score if best is None else (best[:, :, None] + self.step[None]).max(axis=1) + score
        return best

    def decode(self, lines: list[str], entering: int | None, leaving: int | None) -> list[int]:
        """Best states given the state before (None: the start) and of the last line (None: free)."""
        back, best = [], None
        for score in self.scores(lines):
            if best is None:
                best = (self.start if entering is None else self.step[entering]) + score
            else:
                options = best[:, None] + self.step
                back.append(options.argmax(axis=0))
                best = options.max(axis=0) + score
        state = int(best.argmax()) if leaving is None else leaving
        states = [state]
        for choice in reversed(back):
            state = int(choice[state])
            states.append(state)
        return states[::-1]


# shares of what is expected without any training conversation
PRIOR_START, PRIOR_NEXT, PRIOR_MARKER, PRIOR_KIND, STRAY = 0.2, 0.15, 0.1, 0.3, 0.001


def fit(conversations: list[list[tuple[str, list[str]]]]) -> Model:
    """Shares counted over conversations of (role, lines) turns, mixed with what holds for any transcript.

    Any role may open a transcript and follow any other; how long turns are, and the
    kinds of lines inside them, are the same for all roles; the names of STYLES are
    known for their roles; a known name stands for another role, or inside a turn, in
    one line of a thousand at most unless the conversations show more.  So a known
    marker outweighs the order in which the roles of the conversations stand.
    """
    known = Counter(marker(lines[0])[0] for turns in conversations for _, lines in turns if lines)
    names = {marker(m)[0]: role for style in STYLES for role, m in zip(ROLES, style)}
    markers = {"": 0}
    for name in [*sorted(names), *sorted(n for n, c in known.items() if n and c > 1 and n not in names)]:
        markers[name] = len(markers)
    roles, other = len(ROLES), len(markers)
    start, follows = np.zeros(roles), np.zeros((roles, roles))
    goes_on = np.ones((2, 2))  # opening or inner line, then turn ends or goes on
    sees_marker, sees_kind = np.zeros((len(STATES), other + 1)), np.ones((len(STATES), 5))
    for turns in conversations:
        before = None
        for role, lines in turns:
            now = ROLES.index(role)
            if before is None:
                start[now] += 1
            else:
                follows[before, now] += 1
            before = now
            goes_on[int(len(lines) > 1), 0] += 1
            goes_on[0, 1] += len(lines) > 1
            goes_on[1, 1] += max(0, len(lines) - 2)
            for k, line in enumerate(lines):
                state = STATES.index((role, k == 0))
                sees_marker[state, markers.get(marker(line)[0], other)] += 1
                sees_kind[state, kind(line)] += 1

    def mixed(counts: np.ndarray, prior: np.ndarray, share: float) -> np.ndarray:
        total = counts.sum(axis=-1, keepdims=True)
        return np.where(total > 0, (1 - share) * counts / np.maximum(total, 1) + share * prior, prior)

    start, follows = mixed(start, np.full(roles, 1 / roles), PRIOR_START), mixed(follows, np.full((roles, roles), 1 / roles), PRIOR_NEXT)
    goes_on /= goes_on.sum(axis=1, keepdims=True)
    opening, step = np.zeros(len(STATES)), np.zeros((len(STATES), len(STATES)))
    marker_prior, kinds = np.zeros_like(sees_marker), np.zeros_like(sees_kind)
    for k, (role, opens) in enumerate(STATES):
        now, line = ROLES.index(role), int(not opens)
        opening[k] = start[now] if opens else 0
        for j, (after, next_opens) in enumerate(STATES):  # a line inside a turn follows a line of that turn
            step[k, j] = goes_on[line, 0] * follows[now, ROLES.index(after)] if next_opens else goes_on[line, 1] * (after == role)
        own = [markers[n] for n, r in names.items() if r == role] if opens else [0, other]
        marker_prior[k, own] = 1 / len(own)
        together = sees_kind[[i for i, (_, x) in enumerate(STATES) if x == opens]].sum(axis=0)
        kinds[k] = mixed(sees_kind[k], together / together.sum(), PRIOR_KIND if opens else 1.0)
    seen = (1 - STRAY) * mixed(sees_marker, marker_prior, PRIOR_MARKER) + STRAY / (other + 1)
    log = lambda p: np.log(np.maximum(p, 1e-12))
    return Model(markers, log(opening), log(step), np.log(seen), np.log(kinds))


def parse(segments: DataFrame, model: Model) -> DataFrame:
    """Turns of transcripts given as (conv_id, segment, transcript): conv_id, segment, line, role, text, rendered.

    `line` is the number of the turn's first line in its segment.  A turn that runs
    over the end of a segment continues in the next one as a row with opens = false.
    The marker of a turn's first line is left out if its name is known; any other
    first words stay.  A null transcript has no lines, an empty one has one empty line;
    equal segment numbers of a conversation follow each other in the order of their
    texts, null ones first, and repeated rows are all parsed; null conv_ids are one
    conversation; equally likely states go to the first of STATES; an empty table
    gives no rows.  Other columns are left out.
    """
    kind_of = segments.schema["conv_id"].dataType.simpleString()
    spark = segments.sparkSession
    shared = spark.sparkContext.broadcast((model.markers, model.start, model.step, model.sees_marker, model.sees_kind))
    rows = segments.select("conv_id", "segment", "transcript").where("transcript is not null").withColumn("tie", F.xxhash64("transcript"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "segments")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            best = [own.through(t.split("\n")).ravel().tolist() for t in batch.column("transcript").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "segment", "tie", "row")], pa.array(best, pa.list_(pa.float64()))], ["conv_id", "segment", "tie", "row", "best"])

    # a conversation of one segment needs no chaining
    many = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"))
    long = rows.join(many, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    matrices = long.mapInArrow(measure, f"conv_id {kind_of}, segment long, tie long, row long, best array<double>")

    def chain(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["segment", "tie", "row"], kind="stable")
        best, back = None, []
        for flat in found["best"]:
            matrix = np.array(flat).reshape(-1, len(STATES))
            if best is None:
                best = matrix[-1]
            else:
                options = best[:, None] + matrix[:-1]
                back.append(options.argmax(axis=0))
                best = options.max(axis=0)
        state = int(best.argmax())
        ends = [state]
        for choice in reversed(back):
            state = int(choice[state])
            ends.append(state)
        ends = ends[::-1]
        return pd.DataFrame({"row": found["row"].to_numpy(), "before": [-1, *ends[:-1]], "leaving": ends})

    ends = matrices.groupBy("conv_id").applyInPandas(chain, "row long, before int, leaving int")
    dealt = rows.join(ends, "row", "left")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                lines = row["transcript"].split("\n")
                before = None if row["before"] in (None, -1) else row["before"]
                states = own.decode(lines, before, row["leaving"])
                turns: list[list] = []

                def bare(line: str) -> str:
                    name, length = marker(line)
                    return line[length:] if name in own.markers else line

                for k, (line, state) in enumerate(zip(lines, states)):
                    role, opens = STATES[state]
                    if opens or not turns:
                        turns.append([k, role, opens, [bare(line) if opens else line]])
                    else:
                        turns[-1][3].append(line)
                for k, role, opens, text in turns:
                    whole = "\n".join(text)
                    out.append((row["conv_id"], row["segment"], k, role, opens, whole, f"<|{role}|>\n{whole}\n<|end|>\n" if opens else whole))
            names = ["conv_id", "segment", "line", "role", "opens", "text", "rendered"]
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    return dealt.select("conv_id", "segment", "transcript", "before", "leaving").mapInArrow(
        decode, f"conv_id {kind_of}, segment long, line long, role string, opens boolean, text string, rendered string"
    )


def _style(conv_id) -> F.Column:
    return F.pmod(F.xxhash64(conv_id), F.lit(len(STYLES)))


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as plain transcripts with one of several marker styles per conversation, in segments."""
    styles = F.array(*[F.create_map(*[F.lit(x) for pair in zip(ROLES, style) for x in pair]) for style in STYLES])
    name = F.element_at(styles, (_style(F.col("conv_id")) + 1).cast("int"))
    line = F.concat(F.coalesce(F.element_at(name, F.lower("role")), F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", F.floor(F.coalesce("turn", F.lit(0)) / TURNS_PER_SEGMENT).alias("segment"), F.struct("turn", line.alias("line")).alias("l"))
    rows = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("l")).alias("l"))
    return rows.select("conv_id", "segment", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def train(conversations: DataFrame, max_conversations: int = 400, max_turns: int = 60) -> Model:
    """Counts on at most max_conversations conversations (by hash of the id) of at most max_turns turns."""
    sizes = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_turns)
    sample = sizes.orderBy(F.xxhash64("conv_id"), "conv_id").limit(max_conversations).select("conv_id", _style(F.col("conv_id")).alias("style"))
    found = conversations.join(F.broadcast(sample), "conv_id").toPandas().sort_values(["conv_id", "turn"], kind="stable")
    out = []
    for _, turns in found.groupby("conv_id", sort=True):
        rows = []
        for style, role, text in zip(turns["style"], turns["role"].str.lower(), turns["text"].fillna("")):
            if role in ROLES:
                lines = (STYLES[style][ROLES.index(role)] + text).split("\n")
                rows.append((role, lines))
        out.append(rows)
    return fit(out)


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    turns = parse(transcripts(conversations), train(conversations))
    return turns.select("conv_id", "segment", "line", "role", "opens", "rendered")
