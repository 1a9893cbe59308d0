"""Repair of conversations by a dynamic program over the turns that stay.

`repair` brings the roles of each conversation into the form `(s?(ua)+)?`: an optional system turn, then user and assistant in turn. An
edit keeps a row (cost 0), gives it the role user or assistant (2), deletes it (3; blank and duplicate rows have to go) or
inserts an empty turn (2); a truncated row that stays costs 1 more. Of the cheapest repairs the one whose audit, the edits'
initials in order (Delete, Insert, Keep, Rerole), is least in ASCII is taken.

The program decides for each row whether it is the next turn that stays, under its own role or another. Between two turns that stay
everything is deleted, so a gap's price is a difference of the prefix sums of deletions; a state (the role of the last turn that stayed, or that none
did) therefore needs one running minimum, its best cost less the deletions up to there. The pair of roles settles how many turns are inserted
between them, and deletions come before insertions, as D precedes I. Two prefixes that have consumed the same rows and end with a row are never one
the beginning of the other, so their order is that of the whole audits, and a rank of four states stands for the strings.

Faults, the first of which counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (the
last character that is no white space is none of `.!?`).

Distribution: rows are dealt by conversation once, with their texts. Duplicates are found by a window within that dealing, then each
conversation streams through in order of turn. Every state carries a running SHA-256 of its repaired text, so no text is held back: what a task
holds of a conversation is a byte a row and state for the audit, which is a row of the result anyway. A conversation is one task's, however long,
because its digest is a chain over its text.

Rows: a null role or text is one space; so a null text is blank, and a role without the initial s, u or a (an empty one too) cannot be kept. Null turns
come first; rows of one turn are ordered by role and text. A null conv_id is a conversation of its own. Of repeated rows all but one are duplicates. A
conversation that has no rows left gets zeros, an empty audit and the digest of nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": b"user", "a": b"assistant"}
_NEVER = 1 << 60
#: States: no turn has stayed, or the last one that stayed is s, u or a.
_START, _S, _U, _A = range(4)
_STATE = {"s": _S, "u": _U, "a": _A}
#: What is inserted between a state and the next role (u, a, or the end), and which pairs are legal as they are.
BETWEEN = {(_START, _S): "", (_START, _U): "", (_START, _A): "u", (_S, _U): "", (_S, _A): "u", (_U, _U): "a", (_U, _A): "", (_A, _U): "", (_A, _A): "u"}
AT_END = {_START: "", _S: "ua", _U: "a", _A: ""}
LEGAL = {"su", "ua", "au"}


def damage(rows: DataFrame) -> DataFrame:
    """`conversations` with faults put in by the checksum of `conv_id:turn`, and `gone` for rows that it drops.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks away, 3 repeats it and 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    made = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("__kind"))
    return made.withColumn("__n", F.explode(F.sequence(F.lit(1), F.when(F.col("__kind") == 3, 2).otherwise(1)))).drop("__n", "__kind")


class Repair:
    """One conversation, row by row."""

    def __init__(self) -> None:
        self.n = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = self.seen = None
        self.turns = 0
        self.before: str | None = None
        # best[state]: its cost less the deletions so far; rank[state]: the place of its audit among the four.
        self.best, self.rank = [0, _NEVER, _NEVER, _NEVER], [0, 1, 2, 3]
        self.text = [hashlib.sha256() for _ in range(4)]
        # back[state][row]: 0 if the row is deleted on the way to the state, else 1 + the state before, plus 8 if it gets another role.
        self.back = [bytearray() for _ in range(4)]

    def _say(self, digest, empty: bool, role: bytes, text: bytes) -> None:
        if not empty:
            digest.update(b"\n")
        digest.update(role + b":")
        digest.update(text)

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += turn != self.seen or self.turns == 0
            self.seen = turn
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.n and self.before + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        best, rank = self.best, self.rank
        chosen = [(best[s], (rank[s], "D"), 0) for s in range(4)]
        if fault not in ("blank", "duplicate"):
            own, more = _STATE.get(initial), TRUNCATED * (fault == "truncated") - DELETE  # the row's own deletion is not paid
            for to, price, letter in ((_S, 0, "K"), (_U, 0, "K"), (_A, 0, "K"), (_U, REROLE, "R"), (_A, REROLE, "R")):
                if (letter == "K") != (own == to):
                    continue
                for state in range(4):
                    between = BETWEEN.get((state, to))
                    if between is None or best[state] >= _NEVER:
                        continue
                    found = (best[state] + INSERT * len(between) + price + more, (rank[state], "I" * len(between) + letter), 1 + state + 8 * (letter == "R"))
                    if found < chosen[to]:
                        chosen[to] = found
        said = self.text
        encoded, kept = text.encode("utf-8", "replace"), role.encode("utf-8", "replace")
        new = []
        for s, (_, _, how) in enumerate(chosen):
            if not how:
                new.append(said[s])
                continue
            state = (how & 7) - 1
            digest, empty = said[state].copy(), state == _START
            for initial in BETWEEN[state, s]:
                self._say(digest, empty, ROLES[initial], b"")
                empty = False
            self._say(digest, empty, ROLES["ua"[s - _U]] if how & 8 else kept, encoded)
            new.append(digest)
        self.text = new
        self.best = [c for c, _, _ in chosen]
        places = sorted(range(4), key=lambda s: chosen[s][1])
        self.rank = [places.index(s) for s in range(4)]
        for s in range(4):
            self.back[s].append(chosen[s][2])
        self.n += 1

    def result(self) -> dict:
        """The counts, cost, audit and digest."""
        ends = [(self.best[s] + INSERT * len(AT_END[s]), (self.rank[s], "I" * len(AT_END[s])), s) for s in range(4) if self.best[s] < _NEVER]
        cost, _, state = min(ends)
        for initial in AT_END[state]:
            self._say(self.text[state], False, ROLES[initial], b"")
        digest = self.text[state].hexdigest()
        parts = ["I" * len(AT_END[state])]
        for i in range(self.n - 1, -1, -1):
            how = self.back[state][i]
            if how:
                parts.append("R" if how & 8 else "K")
                parts.append("I" * len(BETWEEN[(how & 7) - 1, state]))
                state = (how & 7) - 1
            else:
                parts.append("D")
        gaps = min(self.high - self.low + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return {"gaps": gaps, **self.counts, "cost": cost + DELETE * self.n, "audit": "".join(reversed(parts)), "repaired_sha256": digest}


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn -> a row for each conversation."""
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    now, open_, done = None, None, []
    kind = None

    def out() -> pa.RecordBatch:
        columns = [pa.array([c for c, _ in done], kind)]
        columns += [pa.array([r[n] for _, r in done], pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *names])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for conv, turn, role, text, gone, fault in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault"))):
                if open_ is None or conv != now:
                    if open_ is not None:
                        done.append((now, open_.result()))
                    now, open_ = conv, Repair()
                if not gone:
                    open_.row(turn, role, text, fault)
        if len(done) >= 1024:
            yield out()
            done = []
    if open_ is not None:
        done.append((now, open_.result()))
    if done:
        yield out()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    `rows` has conv_id, turn (a whole number), role, text, and `gone` where a row only says that its conversation is there.
    """
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.when(~F.col("gone"), space(c)).alias(c) for c in ("role", "text")], "gone")
    # The window needs no dealing of its own: rows of one conversation are together already.
    again = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.col("again") > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    judged = here.repartition("conv_id").withColumn("again", F.row_number().over(again)).withColumn("fault", fault)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("again")]
    kind = dict(rows.dtypes)["conv_id"]
    columns = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return judged.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(_stream, columns)
