"""Chat formatting: conversations become budgeted windows of whole turns. Prefix sums of turn tokens choose the
spans, the system turn leads every window, a limited history is repeated, and repeated targets are masked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import pieces as slices, schemas
from rasterloom.llm.token_counts import counter

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
_ESCAPE = str.maketrans({"\\": "\\\\", "<": "\\<", ">": "\\>"})
_TURN = re.compile(r"<turn ([^\\<>]*(?:\\.[^\\<>]*)*)>([^\\<>]*(?:\\.[^\\<>]*)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes and angle brackets get a backslash, so no text can hold a control string."""
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"<turn {escape(role)}>{escape(text)}</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


class _Windows:
    """Windows of one conversation, fed turn by turn; holds one window and the history before it."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int, targets: frozenset[str]):
        self.budget, self.history_turns, self.history_tokens, self.targets = budget, history_turns, history_tokens, targets
        self.system: list[tuple] = []
        self.history: list[tuple] = []
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of the tokens of the new turns
        self.index = 0
        self.fixed = 0  # tokens of the system turn and the history

    def add(self, role: str, text: str, formatted: str, tokens: int) -> dict | None:
        """Take a turn; returns the window that it closes, if any. A turn is never cut: one that is larger than the
        budget gets a window without other new turns."""
        turn = (role, text, formatted, tokens)
        closed = None
        if self.new and self.fixed + self.sums[-1] + tokens > self.budget:
            closed = self.close()
        if self.index and not self.new:  # a later window begins: history as far as it fits beside this turn
            room = min(self.history_tokens, self.budget - tokens - sum(t[3] for t in self.system))
            while self.history and sum(t[3] for t in self.history) > room:
                self.history.pop(0)
            self.fixed = sum(t[3] for t in [*self.system, *self.history])
        self.new.append(turn)
        self.sums.append(self.sums[-1] + tokens)
        return closed

    def close(self) -> dict | None:
        if not self.new:
            return None
        repeated = [*self.system, *self.history] if self.index else []
        text, at, spans = "", 0, []
        parts = []
        for i, (role, content, formatted, _) in enumerate([*repeated, *self.new]):
            if role in self.targets and i >= len(repeated):
                begin = at + len(f"<turn {escape(role)}>")
                spans.append((begin, at + len(formatted) - len("</turn>\n")))
            parts.append(formatted)
            at += len(formatted)
        text = "".join(parts)
        made = {"window": self.index, "text": text, "repeated_turns": len(repeated), "n_tokens": self.fixed + self.sums[-1], "loss_starts": [a for a, _ in spans], "loss_ends": [b for _, b in spans]}
        if not self.index and self.new[0][0] == "system":
            self.system = [self.new[0]]
        rest = [t for t in self.new if not (self.system and t is self.system[0])]
        self.history = [*self.history, *rest][-self.history_turns :] if self.history_turns else []
        self.new, self.sums, self.index = [], [0], self.index + 1
        return made


def format_windows(df: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, targets: tuple[str, ...] = ("assistant",), tokenizer: str | None = None) -> DataFrame:
    """Format conversations given as rows (conv_id, turn, role, text).

    Returns per window: conv_id, window, text, repeated_turns (its first turns, taken from earlier windows),
    n_tokens, loss_starts and loss_ends (code points of the escaped target texts; repeated ones are left out).
    Turns are ordered by turn, then role and text; repeated rows are turns of their own; null roles and texts count
    as empty, a null conv_id is a conversation; other columns are ignored, whatever their names; an empty table gives
    no windows. Turns are never cut: a window of one new turn may exceed the budget, when the turn alone or together
    with the system turn does; history never makes it. Rows are dealt out by conversation,
    sorted by Spark and streamed, so a task holds one window at a time however long a conversation is. Windows of a
    conversation leave a partition together and in order."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    kind = df.schema["conv_id"].dataType.simpleString()
    out, arrow = schemas(f"conv_id {kind}, window long, text string, repeated_turns long, n_tokens long, loss_starts array<long>, loss_ends array<long>")
    wanted = frozenset(targets)
    empty = F.lit("")
    rows = df.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, state = counter(tokenizer), None, None
        made: list[tuple] = []

        def ready() -> pa.RecordBatch:
            cols = [[k for k, _ in made], *([w[f.name] for _, w in made] for f in list(arrow)[1:])]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        def keep(window: dict | None) -> None:
            if window:
                made.append((now, window))

        for batch in batches:
            for piece in slices(batch):
                ids, roles, texts = (piece.column(i).to_pylist() for i in range(3))
                turns = [format_turn(r, t) for r, t in zip(roles, texts)]
                for conv, role, text, turn, n in zip(ids, roles, texts, turns, count(turns)):
                    if state is None or conv != now:
                        if state is not None:
                            keep(state.close())
                        now, state = conv, _Windows(budget, history_turns, history_tokens, wanted)
                    keep(state.add(role, text, turn, n))
                yield ready()
        if state is not None:
            keep(state.close())
        yield ready()

    return rows.mapInArrow(run, out)


def read_back(windows: DataFrame) -> DataFrame:
    """Parse formatted windows again and digest each conversation's turns and loss texts.

    Needs the windows of a conversation together and in order, as format_windows() leaves them. Returns conv_id,
    n_turns, turns_sha256 (role, newline, text, newline for each turn once), loss_chars, loss_sha256, formatted_chars,
    n_windows. A null text is a window without turns, null places mask nothing, null repeated_turns repeat none; a null
    conv_id is a conversation; a window given twice counts twice; texts may be of any length; other columns are
    ignored, whatever their names; an empty table gives none."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    out, arrow = schemas(f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, made = None, None, []

        def finish() -> None:
            made.append((now, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["windows"]))

        def ready() -> pa.RecordBatch:
            cols = list(zip(*made)) or [[] for _ in arrow]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for piece in slices(batch):
                cols = [piece.column(i).to_pylist() for i in range(5)]
                for conv, text, repeated, starts, ends in zip(*cols):
                    if state is None or conv != now:
                        if state is not None:
                            finish()
                        now, state = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "windows": 0}
                    text = text or ""
                    for role, content in parse(text)[repeated or 0 :]:
                        state["n"] += 1
                        state["turns"].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                    for a, b in zip(starts or (), ends or ()):
                        target = unescape(text[a:b])
                        state["chars"] += len(target)
                        state["loss"].update(target.encode("utf-8", "surrogatepass"))
                    state["size"] += len(text)
                    state["windows"] += 1
                yield ready()
        if state is not None:
            finish()
        yield ready()

    return windows.select("conv_id", "text", "repeated_turns", "loss_starts", "loss_ends").mapInArrow(run, out)
