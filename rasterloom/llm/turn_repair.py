"""Repair of conversations whose turns are lost, empty, repeated, cut or of the wrong role.

Turns are aligned to the strings that the grammar (s?(ua)+)? allows, by Wagner and Fischer's matrix: one string for each
feasible length, in Ukkonen's band of what the best alignment so far (the incumbent) has cost; of equally cheap
alignments the backtraced audits are compared.

A long conversation is aligned in chunks. What a chunk needs of those before it is only the last role that was given
out (its state), so it is aligned from each state to each state, and chunks join by their costs and by the order of their audits:
those of one start each hold an operation for every turn and end with one, none begins another, so the order of two
joined audits is that of their first different parts. In the same way the sorted partitions that Spark makes of all turns
join, whose borders may lie in a conversation of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import pieces, schemas, written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Turns that are aligned at once.
CHUNK = 12
#: States: nothing given out, then the role given out last.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAMES = {"u": "user", "a": "assistant"}
#: What a state still needs at the end.
_ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_LEGAL = {"su", "ua", "au"}
_WHITE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60


def next_role(state: int) -> str:
    """The role that an inserted or changed turn gets."""
    return "a" if state == USER else "u"


def _target(state: int, size: int, system: bool) -> str:
    """The grammar's string of a length after a state."""
    first = "au" if state == USER else "ua"
    return "s" + _target(SYSTEM, size - 1, False) if system else (first * (size // 2 + 1))[:size]


def _wagner_fischer(turns: list[tuple[str, bool, bool]], target: str, most: int) -> tuple[int, str] | None:
    """Cost and ASCII-least audit of the cheapest alignment of turns (initial, must go, truncated) to a target, if it
    costs at most `most`. The last operation is on the last turn.

    Cells hold the cost of what follows, so that the audit is read from the front."""
    n, m = len(turns), len(target)

    def bound(rows: int, columns: int) -> int:
        return INSERT_COST * (columns - rows) if columns > rows else DELETE_COST * (rows - columns)

    def operations(i: int, j: int) -> Iterator[tuple[str, int, int, int]]:
        initial, go, truncated = turns[i]
        yield DELETE, i + 1, j, DELETE_COST
        if j < m:
            c, cut = target[j], TRUNCATED_COST * truncated
            if c != "s":
                yield INSERT, i, j + 1, INSERT_COST
            if not go and initial == c:
                yield KEEP, i + 1, j + 1, cut
            if not go and c != "s":
                yield REROLE, i + 1, j + 1, REROLE_COST + cut

    cost = {(n, m): 0}
    for i in range(n - 1, -1, -1):
        for j in range(m, -1, -1):
            if bound(i, j) + bound(n - i, m - j) <= most:  # the band
                least = min(cost.get((x, y), _FAR) + c for _, x, y, c in operations(i, j))
                if least + bound(i, j) <= most:
                    cost[i, j] = least
    total, at, audit = cost.get((0, 0)), (0, 0), []
    if total is None:
        return None
    while at[0] < n:
        letter, to = min((o, (x, y)) for o, x, y, c in operations(*at) if cost.get((x, y), _FAR) + c == cost[at])
        audit.append(letter)
        at = to
    return total, "".join(audit)


def align(turns: list[tuple[str, bool, bool]], state: int) -> dict[int, tuple[int, str]]:
    """For each state that the turns can leave: the least cost and of the cheapest audits the ASCII-least."""
    best: dict[int, tuple[int, str]] = {}
    forced = sum(go for _, go, _ in turns)
    stay = len(turns) - forced
    fixed = DELETE_COST * forced + TRUNCATED_COST * sum(cut and not go for _, go, cut in turns)
    less = DELETE_COST - TRUNCATED_COST if any(cut for _, _, cut in turns) else DELETE_COST  # for a deletion that isn't forced
    bound = lambda size: fixed + (INSERT_COST * (size - stay) if size > stay else less * (stay - size))
    kinds = [False] + [True] * (state == START and any(not go and initial == "s" for initial, go, _ in turns))
    for system in kinds:
        for odd in (0, 1):
            sizes = sorted((x for x in range(odd, 3 * len(turns) + 4, 2) if x or not system), key=lambda x: (bound(x), x))
            for size in sizes:
                target = _target(state, size, system)
                leave = _STATE[target[-1]] if target else state
                if bound(size) > best.get(leave, (_FAR,))[0]:
                    continue
                found, more = None, 8
                while found is None and more < 16 * (len(turns) + 1):  # without an incumbent the band doubles until it holds an alignment
                    found, more = _wagner_fischer(turns, target, min(best.get(leave, (_FAR,))[0], bound(size) + more)), 2 * more
                if found and (leave not in best or found < best[leave]):
                    best[leave] = found
    return best


def repaired(audit: str, state: int, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """What an audit makes of turns (role, text) after a state: `role:text`, a newline before all but the first."""
    for letter in audit:
        role, text = ("", "") if letter == INSERT else next(turns)
        if letter == DELETE:
            continue
        if letter != KEEP:
            role = _NAMES[next_role(state)]
        yield f"{'' if state == START else chr(10)}{role}:{text}"
        state = _STATE[role[0]]


def _flat(link: tuple | None) -> str:
    """The audit of a chain of (chain before, audit)."""
    parts = []
    while link:
        link, part = link
        parts.append(part)
    return "".join(reversed(parts))


class _Path:
    """Best alignment so far that leaves one state: cost, rank of its audit among those of the same start, chain of audits, digest."""

    def __init__(self, cost: int, rank: int, link: tuple | None, digest=None):
        self.cost, self.rank, self.link, self.digest = cost, rank, link, digest


class _Piece:
    """The turns of one conversation in one sorted partition."""

    def __init__(self, at: tuple, entries: tuple[int, ...], digests: bool):
        self.at = at  # conversation and place in the order of all turns
        self.paths = {e: {e: _Path(0, 0, None, hashlib.sha256() if digests else None)} for e in entries}
        self.chunk: list[tuple] = []
        self.turns: list[int] = []  # first and last turn
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initials: list[str] = []  # first and last
        self.marked = self.before = None

    def add(self, turn: int | None, told: bytes, role: str, text: str) -> None:
        here = (turn, told)
        body = text.rstrip(_WHITE)
        blank, again = not body, here in (self.marked, self.before)
        cut = bool(body) and body[-1] not in ".!?"
        self.before = here
        self.blank += blank
        self.duplicate += not blank and again
        self.truncated += not again and cut
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.n_turns += 1
        if self.initials:
            self.illegal += self.initials[1] + role[:1] not in _LEGAL
        self.initials = [self.initials[0] if self.initials else role[:1], role[:1]]
        if len(self.chunk) == CHUNK:
            self._close()
        self.chunk.append(((role[:1], blank or again, cut and not again), role, text))

    def _steps(self, entry: int) -> Iterator[tuple[int, tuple, int, str]]:
        """(state left, (cost, rank, audit), state before, audit) of all ways over the open chunk."""
        if not hasattr(self, "_aligned"):
            self._aligned: dict[int, dict] = {}
        for state, path in self.paths[entry].items():
            if state not in self._aligned:
                self._aligned[state] = align([c[0] for c in self.chunk], state)
            for leave, (cost, audit) in self._aligned[state].items():
                yield leave, (path.cost + cost, path.rank, audit), state, audit

    def _digest(self, path: _Path, state: int, audit: str):
        digest = path.digest.copy()
        for line in repaired(audit, state, ((role, text) for _, role, text in self.chunk)):
            digest.update(line.encode("utf-8", "surrogatepass"))
        return digest

    def _close(self) -> None:
        """Go over the open chunk."""
        if not self.chunk:
            return
        self._aligned = {}
        for entry, paths in self.paths.items():
            best: dict[int, tuple] = {}
            for leave, order, state, audit in self._steps(entry):
                if leave not in best or order < best[leave][0]:
                    best[leave] = (order, state, audit)
            ranked = {leave: i for i, leave in enumerate(sorted(best, key=lambda x: best[x][0][1:]))}
            self.paths[entry] = {
                leave: _Path(cost, ranked[leave], (paths[state].link, audit), self._digest(paths[state], state, audit) if paths[state].digest else None)
                for leave, ((cost, _, _), state, audit) in best.items()
            }
        self.chunk = []

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of a whole conversation."""
        self._aligned = {}
        ends = [((order[0] + INSERT_COST * len(_ENDING[leave]), *order[1:]), leave, state, audit) for leave, order, state, audit in self._steps(START)]
        order, leave, state, audit = min(ends)
        path, audit = self.paths[START][state], audit + _ENDING[leave]
        gaps = self.turns[1] - self.turns[0] + 1 - self.n_turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, order[0], _flat(path.link) + audit, self._digest(path, state, audit).hexdigest()

    def table(self) -> tuple[list, list]:
        """Numbers and texts that join this piece to its neighbours: (turns, counts, costs and ranks by state before and
        after), (audits by state before and after, first and last initial)."""
        self._close()
        every = [self.paths.get(e, {}).get(x) for e in range(4) for x in range(4)]
        numbers = [*(self.turns or [None, None]), self.n_turns, self.blank, self.duplicate, self.truncated, self.illegal]
        numbers += [p and p.cost for p in every] + [p and p.rank for p in every]
        return numbers, [p and _flat(p.link) for p in every] + (self.initials or [None, None])


class _Whole:
    """A conversation put together from pieces: their tables first, then their audits and turns."""

    def __init__(self):
        self.paths: dict[int, tuple] = {START: (0, 0, None)}
        self.turns, self.counts, self.last, self.chosen = [], [0] * 5, None, None

    def join(self, numbers: list, texts: list) -> None:
        first, last, *counts = numbers[:7]
        if first is not None:
            counts[0] -= bool(self.turns) and self.turns[1] == first
            self.turns = [self.turns[0] if self.turns else first, last]
        begin, end = texts[16:]
        counts[4] += None not in (self.last, begin) and self.last + begin not in _LEGAL
        self.last = self.last if end is None else end
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        best: dict[int, tuple] = {}
        for state, (cost, rank, link) in self.paths.items():
            for leave in range(4):
                more = numbers[7 + 4 * state + leave]
                if more is not None:
                    way = (cost + more, rank, numbers[23 + 4 * state + leave], (link, (state, leave)))
                    if leave not in best or way[:3] < best[leave][:3]:
                        best[leave] = way
        ranked = {leave: i for i, leave in enumerate(sorted(best, key=lambda x: best[x][1:3]))}
        self.paths = {leave: (cost, ranked[leave], link) for leave, (cost, _, _, link) in best.items()}

    def choose(self) -> None:
        cost, _, self.leave, link = min((cost + INSERT_COST * len(_ENDING[x]), rank, x, link) for x, (cost, rank, link) in self.paths.items())
        ways = []
        while link:
            link, way = link
            ways.append(way)
        self.cost, self.chosen, self.audit, self.digest = cost, iter(reversed(ways)), [], hashlib.sha256()
        self.state, self.letters = START, iter("")

    def audit_of_piece(self, texts: list) -> None:
        self.rest()
        state, leave = next(self.chosen)
        audit = texts[4 * state + leave]
        self.audit.append(audit)
        self.letters = iter(audit)

    def turn(self, role: str, text: str) -> None:
        for letter in self.letters:
            if self._one(letter, role, text):
                break

    def _one(self, letter: str, role: str, text: str) -> bool:
        """Apply a letter; whether it was the turn's own."""
        for line in repaired(letter, self.state, iter([(role, text)])):
            self.digest.update(line.encode("utf-8", "surrogatepass"))
        if letter != DELETE:
            self.state = _STATE[role[0] if letter == KEEP else next_role(self.state)]
        return letter != INSERT

    def rest(self) -> None:
        for letter in self.letters:
            self._one(letter, "", "")

    def result(self) -> tuple:
        self.rest()
        for letter in _ENDING[self.leave]:
            self._one(letter, "", "")
        n_turns, blank, duplicate, truncated, illegal = self.counts
        gaps = self.turns[1] - self.turns[0] + 1 - n_turns if self.turns else 0
        return gaps, blank, duplicate, truncated, illegal, self.cost, "".join(self.audit) + _ENDING[self.leave], self.digest.hexdigest()


_ORDER = ("conv", "turn", "role_head", "text_head", "told")
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(df: DataFrame) -> DataFrame:
    """conv, turn, role, text and gone of conversations (conv_id, turn, role, text) after the damage that the checksum
    of each row's `conv_id:turn` deals out; nulls in it and null roles and texts are one space."""
    blank = F.lit(" ")
    h = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")), F.lit(20))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = df.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(role).alias("role"), text.alias("text"), h.alias("h"))
    times = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", "role", "text", (F.col("h") == 0).alias("gone"), times.alias("time")).drop("time")


def _keyed(turns: DataFrame) -> DataFrame:
    """Turns with what orders them: turn, role and text, the latter two by 64 code points and then a digest."""
    mark = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    told = F.unhex(F.sha2(F.concat_ws("\0", mark, "role", "text"), 256))
    return turns.select("conv", "turn", F.substring("role", 1, 64).alias("role_head"), F.substring("text", 1, 64).alias("text_head"), told.alias("told"), "role", "text", "gone")


def _repeats(turns: DataFrame) -> DataFrame:
    """Marks (conv, turn, role_head, text_head, told) for turns whose role and text the conversation has in an earlier turn."""
    keys = turns.filter("not gone").select(*_ORDER)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = keys.groupBy("told").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).filter("first < last").select("told", "first")
    return keys.join(first, "told").filter(turn > F.col("first")).select(*_ORDER).distinct()


def repair(turns: DataFrame) -> DataFrame:
    """Repair conversations given as (conv, turn, role, text, gone); gone rows only tell that a conversation exists.

    Returns conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Turns are ordered by turn (nulls
    first), then role and text. Spark sorts all turns into ranges, whose borders may cut conversations; every range is
    read once, aligned in chunks, and gives the results of the conversations that lie inside it. The first and the
    last of a range may go on in others (two for each range at most): they leave tables of costs by state, which are joined in order,
    and then their texts are read once more, to apply and digest the chosen operations. A conversation's digest and its audit
    are single values, so one task gives each, as a stream."""
    spark = turns.sparkSession
    kind = turns.schema["conv"].dataType.simpleString()
    keyed = _keyed(turns)
    marks = _repeats(keyed).withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "gone": F.lit(False), "flag": F.lit(0)})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.withColumn("flag", F.lit(1)).unionByName(marks).repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER, "flag")
    places = f"conv {kind}, turn long, role_head string, text_head string, told binary"
    out, arrow = schemas(f"{places}, edge boolean, {_RESULT}, numbers array<long>, texts array<string>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, begins, made = None, True, []
        entries = (START, SYSTEM, USER, ASSISTANT) if TaskContext.get().partitionId() else (START,)

        def leave(edge: bool) -> None:
            made.append((*piece.at, True, *[None] * 8, *piece.table()) if edge else (*piece.at, False, *piece.result(), None, None))

        for batch in batches:
            for part in pieces(batch):
                for conv, turn, role_head, text_head, told, role, text, gone, flag in zip(*(c.to_pylist() for c in part.columns)):
                    if piece is None or conv != piece.at[0]:
                        if piece:
                            leave(begins)
                            begins = False
                        piece = _Piece((conv, turn, role_head, text_head, told), entries if begins and not made else (START,), not begins or entries == (START,))
                    if not flag:
                        piece.marked = (turn, told)
                    elif not gone:
                        piece.add(turn, told, role, text)
                yield _batch(made, arrow)
        if piece:
            leave(True)
        yield _batch(made, arrow)

    told = written(rows.select(*_ORDER, "role", "text", "gone", "flag").mapInArrow(read, out), "pieces")
    return told.filter("not edge").select("conv", *_names()).unionByName(_across(keyed, told.filter("edge")))


def _names() -> list[str]:
    return [c.split()[0] for c in _RESULT.split(", ")]


def _batch(made: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*made)) or [[] for _ in arrow]
    made.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)


def _across(keyed: DataFrame, edges: DataFrame) -> DataFrame:
    """The results of the conversations that have edges: tables, then audits and turns in their order, streamed."""
    kind = keyed.schema["conv"].dataType.simpleString()
    no_text, no_table = F.lit(None).cast("string"), F.lit(None).cast("array<long>")
    tables = edges.select(*_ORDER, F.lit(0).alias("stage"), F.lit(0).alias("flag"), no_text.alias("role"), no_text.alias("text"), "numbers", "texts")
    audits = edges.select(*_ORDER, F.lit(1).alias("stage"), F.lit(0).alias("flag"), no_text.alias("role"), no_text.alias("text"), no_table.alias("numbers"), "texts")
    some = F.broadcast(edges.select(F.col("conv").alias("edge_conv")).distinct())  # two for each range at most
    own = keyed.filter("not gone").join(some, F.col("conv").eqNullSafe(F.col("edge_conv")), "left_semi")
    own = own.select(*_ORDER, F.lit(1).alias("stage"), F.lit(1).alias("flag"), "role", "text", no_table.alias("numbers"), F.lit(None).cast("array<string>").alias("texts"))
    rows = tables.unionByName(audits).unionByName(own).repartition("conv").sortWithinPartitions("conv", "stage", *_ORDER[1:], "flag")
    out, arrow = schemas(f"conv {kind}, {_RESULT}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, made = None, None, []
        for batch in batches:
            for part in pieces(batch):
                for conv, stage, flag, role, text, numbers, texts in zip(*(c.to_pylist() for c in part.columns)):
                    if whole is None or conv != now:
                        if whole:
                            made.append((now, *whole.result()))
                        now, whole = conv, _Whole()
                    if not stage:
                        whole.join(numbers, texts)
                        continue
                    if whole.chosen is None:
                        whole.choose()
                    if flag:
                        whole.turn(role, text)
                    else:
                        whole.audit_of_piece(texts)
                yield _batch(made, arrow)
        if whole:
            made.append((now, *whole.result()))
        yield _batch(made, arrow)

    return rows.select("conv", "stage", "flag", "role", "text", "numbers", "texts").mapInArrow(read, out)


def repair_damaged(df: DataFrame) -> DataFrame:
    """Damage and repair all conversations. Returns for each conv_id what repair() gives.

    Null roles and texts are one space (so blank, and no role of the grammar); a null turn comes first and counts in no
    gap; a null conv_id is a conversation. Rows of one turn are ordered by role and text (64 code points, then a
    digest); repeated rows are duplicates. Roles count by their first character. Conversations and texts may be
    of any length; other columns are ignored, whatever their names; an empty table gives none."""
    return repair(damaged(df)).withColumnRenamed("conv", "conv_id")
