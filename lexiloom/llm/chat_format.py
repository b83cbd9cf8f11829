"""Chat formatting: a hidden Markov model over speaker markers and line features finds roles, Viterbi decides, turns are rendered."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from .common import bounded_batches, ids_hint, written

ROLES = ("system", "user", "assistant")
#: Words that mark a speaker, by role (fixed values).
MARKERS = {
    "system": "system sys context instructions setup",
    "user": "user human q question prompt customer me instruction client",
    "assistant": "assistant ai bot a answer response gpt model agent reply",
}
#: Labelled transcripts that the model is fitted on at most.
FIT_TRANSCRIPTS = 5_000
#: Turns above which a conversation travels in parts, and turns of a part.
WHOLE_TURNS, PART_TURNS = 1_024, 256
#: Turns up to which the roles of a conversation in parts are one value; those of longer ones stand with its parts.
ROLE_TURNS = 1_000_000
#: Steps of a natural logarithm: scores are whole numbers, so that sums do not depend on where a transcript is cut.
UNIT = 1 << 20
#: Numbers of values of the line features: marker, first line, line before is blank, asks, length, is blank.
SIZES = (5, 2, 2, 2, 4, 2)

_WORDS = {w: k + 1 for k, words in enumerate(MARKERS.values()) for w in words.split()}
_MARK = regex.compile(r"^\s{0,3}(?:(?:<\|(?P<tag>\w{1,20})\|>)|(?:\[(?P<box>\w{1,20})\]:?)|(?:[#*]{1,4} ?(?P<head>\w{1,20}) ?[:*]{0,3}(?=\s|$))|(?:(?P<name>\p{L}[\w.-]{0,19}) ?:(?=\s|$)))\s?")


def marker(line: str) -> tuple[int, int]:
    """(0 none, 1 to 3 a role's word, 4 another speaker; characters that the marker takes)."""
    m = _MARK.match(line)
    if not m:
        return 0, 0
    word = next(x for x in m.groups() if x).lower()
    kind = _WORDS.get(word, 4)
    return (kind, m.end()) if kind < 4 or m.group("name") else (0, 0)


def features(lines: list[str], begins: bool = True, after_blank: bool = False) -> np.ndarray:
    """One row of SIZES features per line; begins: the transcript starts here; after_blank: the line before the first is blank."""
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    blank = after_blank
    for i, line in enumerate(lines):
        bare = line.strip()
        out[i] = (marker(line)[0], begins and i == 0, blank, bare.endswith("?"), min(3, len(bare) // 40), not bare)
        blank = not bare
    return out


class Model:
    """States are roles that open a turn (0..2) or go on with it (3..5); logs of start, step and feature chances, smoothed."""

    def __init__(self) -> None:
        self.start, self.step = np.full(6, 0.5), np.full((6, 6), 0.2)
        self.start[3:] = 1e-6
        # only a state of the same role goes on with a turn
        for a in range(6):
            for b in range(3, 6):
                if a % 3 != b % 3:
                    self.step[a, b] = 1e-9
        self.emit = [np.full((6, n), 0.5) for n in SIZES]
        for r in range(3):  # a role's own word opens its turns, others don't, whatever the sample lacks
            self.emit[0][r, r + 1] = 5.0

    def add(self, x: np.ndarray, states: np.ndarray) -> None:
        self.start[states[0]] += 1
        np.add.at(self.step, (states[:-1], states[1:]), 1)
        for k, table in enumerate(self.emit):
            np.add.at(table, (states, x[:, k]), 1)

    def logs(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        whole = lambda x: np.round(np.log(x) * UNIT).astype(np.int64)
        return whole(self.start / self.start.sum()), whole(self.step / self.step.sum(1, keepdims=True)), [whole(t / t.sum(1, keepdims=True)) for t in self.emit]


def forward(x: np.ndarray, logs: tuple, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(best scores of the last line's states, back): back[i] has the best state before each state of line i; ties go to the state
    of smaller number. entry: scores of the states of the line before the first, or None where the transcript starts."""
    start, step, emit = logs
    seen = sum(t[:, x[:, k]] for k, t in enumerate(emit)).T
    back = np.zeros((len(x), 6), np.int64)
    every = np.arange(6)
    score = entry
    for i in range(len(x)):
        if score is None:
            score = start + seen[0]
            continue
        ways = score[:, None] + step
        back[i] = ways.argmax(0)
        score = ways[back[i], every] + seen[i]
    return score, back


def backward(back: np.ndarray, end: int) -> tuple[np.ndarray, int]:
    """(states of the lines, state of the line before the first), from the state of the last line."""
    out = np.zeros(len(back), np.int64)
    for i in range(len(back) - 1, -1, -1):
        out[i] = end
        end = int(back[i, end])
    return out, end


def viterbi(x: np.ndarray, logs: tuple) -> np.ndarray:
    """The likeliest states of a transcript's lines."""
    score, back = forward(x, logs)
    return backward(back, int(score.argmax()))[0]


def passage(x: np.ndarray, logs: tuple) -> np.ndarray:
    """ways[i, j]: the best score of lines that follow state i and end in state j."""
    _, step, emit = logs
    seen = sum(t[:, x[:, k]] for k, t in enumerate(emit)).T
    ways = step + seen[0]
    for i in range(1, len(x)):
        ways = (ways[:, :, None] + step[None]).max(1) + seen[i]
    return ways


def rendered(lines: list[str], states: list[int], begins: bool = True, ends: bool = True) -> tuple[str, list[str]]:
    """(chat, roles of the turns that open here). A turn is its head, then each line behind a line feed; speaker markers are left
    out, and so is an opening line that has nothing else. What looks like a turn's frame in the content is broken up. The pieces of
    a transcript that is cut between lines make up the chat of the whole."""
    out: list[str] = []
    roles: list[str] = []
    for i, (line, state) in enumerate(zip(lines, states, strict=True)):
        if state < 3 or (begins and not i):
            out.append(("" if begins and not i else "<|im_end|>\n") + f"<|im_start|>{ROLES[state % 3]}")
            roles.append(ROLES[state % 3])
            line = line[marker(line)[1] :]
            if not line.strip():
                continue
        out.append("\n" + line.replace("<|", "< |"))
    return "".join(out) + ("<|im_end|>\n" if ends else ""), roles


def fit(labelled: DataFrame) -> Model:
    """A model from labelled transcripts (transcript, truth); truth has a letter of the role for each line, a capital where a turn opens.

    What reaches the driver is one table of counts per task. Callers bound the rows by FIT_TRANSCRIPTS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model()
        base = Model()
        for batch in batches:
            for text, truth in zip(batch.column("transcript").to_pylist(), batch.column("truth").to_pylist(), strict=True):
                if truth:
                    m.add(features(text.split("\n")), np.array(["sua".index(c.lower()) + (0 if c.isupper() else 3) for c in truth]))
        parts = [m.start - base.start, m.step - base.step, *[a - b for a, b in zip(m.emit, base.emit, strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], ["counts"])

    model = Model()
    for row in bounded_batches(labelled).select("transcript", "truth").mapInArrow(run, "counts binary").collect():
        start, step, *emit = pickle.loads(bytes(row["counts"]))
        model.start += start
        model.step += step
        for table, more in zip(model.emit, emit, strict=True):
            table += more
    return model


_ANSWER = "n_lines int, n_turns int, roles string, line_roles string, line_accuracy double, chat string, chat_sha256 string"


def _answer(lines: list[str], states: list[int], truth: str, begins: bool = True, ends: bool = True) -> tuple:
    chat, roles = rendered(lines, states, begins, ends)
    said = "".join("sua"[s % 3] for s in states)
    right = sum(a == b for a, b in zip(said, truth.lower(), strict=True)) / len(truth) if truth else None
    return len(lines), len(roles), ",".join(roles), said, right, chat, hashlib.sha256(chat.encode()).hexdigest()


def _answers(ids: list[pa.Array], names: list[str], out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([*ids, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], [*names, *(x.split()[0] for x in _ANSWER.split(", "))])


def _with_truth(df: DataFrame, truth_col: str | None):
    return (F.coalesce(F.col(truth_col), F.lit("")) if truth_col else F.lit("")).alias("truth")


def formatted(transcripts: DataFrame, model: Model, id_cols: tuple[str, ...] = ("conv_id",), text_col: str = "transcript", truth_col: str | None = None) -> DataFrame:
    """(id columns, n_lines, n_turns, roles, line_roles, line_accuracy, chat, chat_sha256) of every transcript.

    roles joins the turns' roles by commas, line_roles has one letter a line; chat is the canonical form. line_accuracy is the
    share of lines whose role is that of truth_col, null without one. Null and empty transcripts have no lines, no turns and an
    empty chat; rows that are wholly alike get the same answers; an empty table gives no rows; other columns are ignored. A
    worker holds one transcript's lines.
    """
    packed = pickle.dumps(model.logs())
    names = list(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = pickle.loads(packed)
        for batch in batches:
            out = []
            for text, truth in zip(batch.column("transcript").to_pylist(), batch.column("truth").to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                states = viterbi(features(lines), logs).tolist() if lines else []
                out.append(_answer(lines, states, truth) if lines else (0, 0, "", "", None, "", hashlib.sha256(b"").hexdigest()))
            if out:
                yield _answers([batch.column(c) for c in names], names, out)

    ids = [F.col(c).cast("long").alias(c) for c in id_cols]
    return bounded_batches(transcripts).select(*ids, F.col(text_col).alias("transcript"), _with_truth(transcripts, truth_col)).mapInArrow(run, ", ".join(f"{c} long" for c in id_cols) + ", " + _ANSWER)


def formatted_parts(parts: DataFrame, model: Model, order_cols: list[str], truth_col: str | None = None) -> DataFrame:
    """formatted() of transcripts that come in parts (conv_id, order_cols, transcript), cut between lines: a row for each part
    (conv_id, part, ...), numbered from 0, as the parse of the whole transcript has it; the parts' chats make up its chat.

    Each part first tells the best score from every state before it to every state at its end. Those tables of 36 numbers are
    added up along a transcript, forwards; each part then knows which state before it leads to every state at its end, and these
    are followed backwards. Two tasks thus stream a few numbers for each part of a transcript, and lines are read part by part.
    Scores are whole numbers, so that the path, ties included, is the one of the uncut transcript.
    """
    packed = pickle.dumps(model.logs())
    order = ", ".join(f"{c} long" for c in order_cols)
    keys = ["conv_id", *order_cols]
    parts = bounded_batches(parts).select(*[F.col(c).cast("long").alias(c) for c in keys], F.coalesce("transcript", F.lit("")).alias("transcript"), _with_truth(parts, truth_col))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = pickle.loads(packed)
        for batch in batches:
            found, blank = [], []
            for text in batch.column("transcript").to_pylist():
                lines = text.split("\n")
                first = forward(features(lines), logs)[0]
                ways = [passage(features(lines, False, b), logs) for b in (False, True)]
                found.append(np.concatenate([first, *(w.ravel() for w in ways)]).tobytes())
                blank.append(not lines[-1].strip())
            if found:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(found, pa.binary()), pa.array(blank)], [*keys, "ways", "blank"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # conversation, part, scores at its end, whether its last line is blank
        for batch in batches:
            out = []
            for conv, ways, blank in zip(batch.column("conv_id").to_pylist(), batch.column("ways").to_pylist(), batch.column("blank").to_pylist(), strict=True):
                ways = np.frombuffer(ways, np.int64)
                if held is None or held[0] != conv:
                    out.append((0, b"", False))
                    held = (conv, 0, ways[:6], blank)
                else:
                    _, part, score, after = held
                    out.append((part + 1, score.tobytes(), after))
                    table = ways[6:].reshape(2, 6, 6)[int(after)]
                    held = (conv, part + 1, (score[:, None] + table).max(0), blank)
            if out:
                kinds = [pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], [*keys, "part", "entry", "after_blank"])

    def decoded(text: str, entry: bytes, after: bool, logs: tuple) -> tuple[list[str], np.ndarray, np.ndarray]:
        lines = text.split("\n")
        return lines, *forward(features(lines, not entry, after), logs, np.frombuffer(entry, np.int64) if entry else None)

    def ways_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = pickle.loads(packed)
        for batch in batches:
            best, before = [], []
            for text, entry, after in zip(*(batch.column(c).to_pylist() for c in ("transcript", "entry", "after_blank")), strict=True):
                _, score, back = decoded(text, entry, after, logs)
                best.append(int(score.argmax()))
                before.append([backward(back, s)[1] for s in range(6)])
            if best:
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(best, pa.int32()), pa.array(before, pa.list_(pa.int32()))], ["conv_id", "part", "best", "before"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # conversation, state at the end of the part before
        for batch in batches:
            out = []
            for conv, best, before in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "best", "before")), strict=True):
                last = held is None or held[0] != conv
                state = best if last else held[1]
                out.append((state, last))
                held = (conv, before[state])
            if out:
                kinds = [pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["conv_id", "part", "end", "last"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = pickle.loads(packed)
        for batch in batches:
            out = []
            for text, truth, entry, after, end, last in zip(*(batch.column(c).to_pylist() for c in ("transcript", "truth", "entry", "after_blank", "end", "last")), strict=True):
                lines, _, back = decoded(text, entry, after, logs)
                out.append(_answer(lines, backward(back, end)[0].tolist(), truth, not entry, last))
            if out:
                yield _answers([batch.column("conv_id"), batch.column("part")], ["conv_id", "part"], out)

    ways = written(parts.mapInArrow(passages, f"conv_id long, {order}, ways binary, blank boolean"), "chat-ways")
    entered = ways.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(entries, f"conv_id long, {order}, part long, entry binary, after_blank boolean")
    entered = written(entered, "chat-entries").toDF(*[f"{c}_" for c in keys], "part", "entry", "after_blank")
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys]
    whole = written(parts.join(entered, on).select("conv_id", "part", "transcript", "truth", "entry", "after_blank"), "chat-parts")
    back = written(whole.mapInArrow(ways_back, "conv_id long, part long, best int, before array<int>"), "chat-back")
    end = back.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part")).mapInArrow(ends, "conv_id long, part long, end int, last boolean")
    end = end.toDF("conv_", "part_", "end", "last")
    return whole.join(end, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_"))).drop("conv_", "part_").mapInArrow(answers, f"conv_id long, part long, {_ANSWER}")


#: Marker styles of raw transcripts: the lead of a system, user and assistant turn; an empty lead leaves the turn unmarked.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("Context: ", "Human: ", "AI: "),
    ("### System\n", "### Instruction\n", "### Response\n"),
    ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"),
    ("Setup: ", "Q: ", "A: "),
    ("Host: ", "Robin: ", "Sam: "),
    ("[system] ", "[user] ", "[bot] "),
    ("", "User: ", ""),
)


ORDER = ["late", "block"]


def raw_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, late, turn, h, text, letters) of every turn, with its marker: what a scraped chat looks like before parsing.

    The style of markers follows from the id. Null roles and roles not in ROLES count as user (as `tool` is for this format), null
    texts are empty, turns without number come last. h orders turns of one number; letters has the role of each line.
    """
    role = F.lower(F.coalesce(F.col("role"), F.lit("user")))
    role = F.when(role.isin(*ROLES), role).otherwise(F.lit("user"))
    conv, turn, text = F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    style = F.pmod(F.xxhash64(F.coalesce(conv, F.lit(0))), F.lit(len(STYLES))).cast("int") + 1
    lead = F.element_at(F.array(*[F.create_map(*[F.lit(x) for pair in zip(ROLES, leads, strict=True) for x in pair]) for leads in STYLES]), style)
    rows = conversations.select(conv.alias("conv_id"), turn.isNull().cast("int").alias("late"), F.coalesce(turn, F.lit(0)).alias("turn"), F.xxhash64(role, text).alias("h"), role.alias("role"), F.concat(lead[role], F.trim(text)).alias("text"))
    letter = F.substring("role", 1, 1)
    return rows.withColumn("letters", F.concat(F.upper(letter), F.repeat(letter, F.regexp_count("text", F.lit("\n"))))).drop("role")


def transcripts(turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, transcript, truth) of the turns of each key, in order."""
    found = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("late", "turn", "h", "text", "letters"))).alias("t"))
    joined = lambda c, by: F.array_join(F.transform("t", lambda x: x[c]), by)
    return found.select(*keys, joined("text", "\n").alias("transcript"), joined("letters", "").alias("truth"))


def in_parts(turns: DataFrame) -> DataFrame:
    """turns of long conversations with the columns ORDER, which cut them into parts of PART_TURNS turns, in order.

    Turns are counted in the order of number and h, whatever their numbers are. Places are found by ranges of numbers; turns of one
    number are spread over ranges by h, and those that are wholly alike, of which the order says nothing, by where they are read.
    """
    rows = written(turns.withColumn("read", F.monotonically_increasing_id()), "chat-turns")
    spread = (F.shiftright("h", 32) + F.lit(1 << 31)) * F.lit(1 << 20) + F.pmod(F.xxhash64("read"), F.lit(1 << 20))
    placed = ranks.numbered(rows, ["conv_id", "late"], F.col("turn") + spread / F.lit(float(1 << 52)), ["turn", "h", "read"])
    return placed.withColumn("block", F.floor((F.col("place") - 1) / PART_TURNS))


def _digest(pieces: Column) -> list[Column]:
    """Aggregates of a 256-bit digest of texts in parts, from a digest of each with its place: four exclusive ors."""
    return [F.bit_xor(F.conv(F.substring(pieces, 16 * k + 1, 16), 16, -10).cast("long")).alias(f"x{k}") for k in range(4)]


def chat_format(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, held_out, n_parts, n_lines, n_turns, roles, line_accuracy, chat_sha256, chat) of the raw transcripts of all
    conversations; line_accuracy is the share of lines whose role is the true one.

    A conversation is one transcript and parsed as one. It has one row, part 0, with the lines, turns, roles, accuracy and digest of
    the whole. Up to WHOLE_TURNS turns its chat stands there, and n_parts is 1. A longer one is cut into n_parts parts, each of
    PART_TURNS turns in order, whatever the turns' numbers are: chat is null in row 0, and rows 1 to n_parts hold the parts, whose
    chats make up the whole and whose other columns are their own. The whole's chat_sha256 is then the exclusive or of the SHA-256 of
    `part:chat_sha256` of its parts, and its roles are null above ROLE_TURNS turns, where the parts have them.

    The model learns from transcripts, or parts, of conversations whose crc32(conv_id as text) mod 5 is not 0, FIT_TRANSCRIPTS at
    most of each, of smallest hash; held_out marks the others.

    Repeated turns all count; of turns with one number the order is that of a hash. Null turn numbers come last, rows without
    conv_id are one conversation, null roles count as user, null texts are empty; an empty table gives no rows; other columns are
    ignored.
    """
    turns = raw_turns(conversations)
    sizes = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "chat-sizes")
    long = ids_hint(written(sizes.where(F.col("n") > WHOLE_TURNS).select(F.col("conv_id").alias("long_id")), "chat-long"))
    out = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))

    few = sizes.where(~out & (F.col("n") <= WHOLE_TURNS)).orderBy(F.xxhash64(F.lit(3), "conv_id"), "conv_id").limit(FIT_TRANSCRIPTS)
    few = F.broadcast(few.select(F.col("conv_id").alias("c")))
    known = transcripts(turns.join(few, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"), ["conv_id"]).select("transcript", "truth")
    parts = None
    if not long.isEmpty():
        parts = written(transcripts(in_parts(turns.join(long, is_long, "left_semi")), ["conv_id", *ORDER]), "chat-cut")
        some = parts.where(~out).orderBy(F.xxhash64(F.lit(3), "conv_id", *ORDER), "conv_id", *ORDER).limit(FIT_TRANSCRIPTS)
        known = known.unionByName(some.select("transcript", "truth"))
    model = fit(known)

    right = F.round("line_accuracy", 6).alias("line_accuracy")
    whole = formatted(transcripts(turns.join(long, is_long, "left_anti"), ["conv_id"]), model, truth_col="truth")
    whole = whole.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("n_parts"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_turns").cast("long").alias("n_turns"), "roles", right, "chat_sha256", "chat")
    if parts is not None:
        pieces = written(formatted_parts(parts, model, ORDER, "truth").withColumn("part", F.col("part") + 1), "chat-pieces")
        named = F.sha2(F.concat_ws(":", "part", "chat_sha256").cast("binary"), 256)
        share = F.sum(F.col("line_accuracy") * F.col("n_lines")) / F.sum(F.when(F.col("line_accuracy").isNotNull(), F.col("n_lines")))
        sums = pieces.groupBy("conv_id").agg(F.count("*").alias("n_parts"), F.sum("n_lines").alias("n_lines"), F.sum("n_turns").alias("n_turns"), F.round(share, 6).alias("line_accuracy"), *_digest(named))
        sums = sums.withColumn("chat_sha256", F.lower(F.concat(*[F.lpad(F.hex(f"x{k}"), 16, "0") for k in range(4)])))
        told = sums.where(F.col("n_turns") <= ROLE_TURNS).select(F.col("conv_id").alias("c"))
        said = pieces.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").where("roles <> ''").groupBy(F.col("conv_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("part", "roles"))).alias("s"))
        said = said.select("c", F.array_join(F.transform("s", lambda x: x["roles"]), ",").alias("roles"))
        heads = sums.join(said, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", F.lit(0).cast("long").alias("part"), "n_parts", "n_lines", "n_turns", "roles", "line_accuracy", "chat_sha256", F.lit(None).cast("string").alias("chat"))
        counts = sums.select(F.col("conv_id").alias("c"), "n_parts")
        rows = pieces.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "part", "n_parts", "n_lines", "n_turns", "roles", right, "chat_sha256", "chat")
        whole = whole.unionByName(heads).unionByName(rows)
    return whole.select("conv_id", "part", out.alias("held_out"), "n_parts", "n_lines", "n_turns", "roles", "line_accuracy", "chat_sha256", "chat")
