"""Repair of the structure of conversations by a forward Viterbi pass.

A conversation's role initials must read ``(s?(ua)+)?``.  Its grammar has four states: nothing
yet, after the system's turn, after a user's, after an assistant's.  Turn by turn, each state
carries the least (cost, audit string) by which the turns so far can end in it; an audit string has the
initials of the edits in order: Keep 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate turns must be
deleted), Insert an empty turn 2; a truncated turn that stays costs 1 more.  After each turn the layer is closed
with at most two inserts, as no more can be of use.  The cheapest string of an accepting state is the repair.

Two strings of one layer have as many letters besides I, and the cost follows from the string, so of two strings with equal
cost none begins with the other, and the least string of a state stays least whatever follows.  States also carry
the hash of their repaired text, so a conversation is read once, in order, however long it is: memory holds
four strings' open ends, and what all of them begin with is put aside.

Turns are dealt by conversation and sorted within a task; nothing holds a whole conversation.  Which turns are the first
of their role and text is known before that, from one aggregation over digests of texts.  A conversation of a third of all
turns is one task's stream all the same, as the hash of its repaired text can only be taken in order; that task's memory
does not grow.

Null role and text are one space; null conv_id is one conversation of its own; null turns come first.  Turns with one number
are ordered by role and by the digest of their text; repeated rows are duplicates.  A turn whose
role starts with another letter than s, u, a can be reroled or deleted.  A conversation
without turns has zeros, an empty audit and the hash of the empty text.  An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State after reading an initial in a state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
#: from state, to state, roles of the inserted turns
CLOSING = ((0, 2, ("user",)), (1, 2, ("user",)), (0, 3, ("user", "assistant")), (1, 3, ("user", "assistant")), (2, 3, ("assistant",)), (3, 2, ("user",)))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
#: Turns after which the strings' common beginning is put aside, at least.
SETTLE = 1024
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repair:
    """The layer of one conversation: per live state its cost, open string, hash and number of repaired turns."""

    def __init__(self) -> None:
        self.settled: list[str] = []
        self.due = SETTLE
        self.turns = 0
        #: state -> (cost, node, hash, repaired turns); a node is [node before, letters]
        self.layer = {0: (0, [None, ""], hashlib.sha256(), 0)}
        #: (a, b) -> -1 or 1 if string a is less or greater at their first difference, or what each has beyond the other
        self.order: dict[tuple[int, int], object] = {}
        self._advance({0: (0, 0, "", ())})

    def _compare(self, a: int, x: str, b: int, y: str):
        """The order of string a followed by x and string b followed by y."""
        if a != b:
            known = self.order[a, b]
            if not isinstance(known, tuple):
                return known
            x, y = known[0] + x, known[1] + y
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return -1 if x[:n] < y[:n] else 1
        return x[n:], y[n:]

    def _offer(self, best: dict, state: int, cost: int, before: int, letters: str, pieces: tuple) -> None:
        """Keep the least way into state; a way is (cost, state before, letters, pieces of repaired text)."""
        old = best.get(state)
        if old is None or cost < old[0] or cost == old[0] and self._compare(before, letters, old[1], old[2]) == -1:
            best[state] = (cost, before, letters, pieces)

    def _advance(self, best: dict) -> None:
        """Close the layer with inserts, then leave the old one."""
        open_ = dict(best)
        for a, b, roles in CLOSING:
            if a in open_:
                cost, before, letters, pieces = open_[a]
                self._offer(best, b, cost + INSERT * len(roles), before, letters + "I" * len(roles), pieces + tuple(f"{r}:".encode() for r in roles))
        # what state 3 can't do as cheaply: from 0, a system turn; from 1, nothing
        least = best[3][0]
        for state, more in ((0, DELETE), (1, 0)):
            if state in best and best[state][0] > least + more:
                del best[state]
        states = list(best)
        order = {}
        for i, a in enumerate(states):
            for b in states[:i]:
                found = self._compare(best[a][1], best[a][2], best[b][1], best[b][2])
                order[a, b] = found
                order[b, a] = found[::-1] if isinstance(found, tuple) else -found
        layer = {}
        for state, (cost, before, letters, pieces) in best.items():
            _, node, digest, n = self.layer[before]
            if pieces:
                digest = digest.copy()
                for piece in pieces:
                    digest.update(b"\n" + piece if n else piece)
                    n += 1
            layer[state] = (cost, [node, letters] if letters else node, digest, n)
        self.layer, self.order = layer, order

    def read(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """One more turn."""
        best: dict = {}
        initial = role[:1]
        for state, (cost, _, _, _) in self.layer.items():
            self._offer(best, state, cost + DELETE, state, "D", ())
            if must_go:
                continue
            cost += TRUNCATED * truncated
            for letter, to in NEXT[state].items():
                if letter == initial:
                    self._offer(best, to, cost + KEEP, state, "K", (f"{role}:{text}".encode(),))
                elif letter in ROLES:
                    self._offer(best, to, cost + REROLE, state, "R", (f"{ROLES[letter]}:{text}".encode(),))
        self._advance(best)
        self.turns += 1
        if self.turns >= self.due:
            self._settle()

    @staticmethod
    def _nodes(node: list) -> list[list]:
        out = []
        while node is not None:
            out.append(node)
            node = node[0]
        return out[::-1]

    def _settle(self) -> None:
        """Put aside what all strings begin with; wait longer if little is common."""
        paths = [self._nodes(node) for _, node, _, _ in self.layer.values()]
        common = 0
        while all(common < len(p) and p[common] is paths[0][common] for p in paths):
            common += 1
        if common:
            last = paths[0][common - 1]
            self.settled.append("".join(n[1] for n in paths[0][:common]))
            last[0], last[1] = None, ""
        self.due = self.turns + max(SETTLE, 2 * max(len(p) - common for p in paths))

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired text) of the cheapest accepting state."""
        best = None
        for state in ACCEPTING:
            if state in self.layer and (best is None or self.layer[state][0] < self.layer[best][0] or self.layer[state][0] == self.layer[best][0] and self._compare(state, "", best, "") == -1):
                best = state
        cost, node, digest, _ = self.layer[best]
        return cost, "".join(self.settled) + "".join(n[1] for n in self._nodes(node)), digest.hexdigest()


def _last_sign(text: Column) -> Column:
    """The last character that is no blank; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)


def _turns(rows: DataFrame) -> DataFrame:
    """The turns with what sorts them, and a mark before the first turn of each (conversation, role, text)."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    turns = rows.select(
        "conv_id", F.col("turn").isNotNull().cast("int").alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.when(gone, -1).otherwise(1).alias("kind"), F.when(~gone, text).alias("text"),
    )
    first = turns.where("kind = 1").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("at"))
    marks = first.select("conv_id", "at.has_turn", "at.turn", "role", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"))
    return turns.unionByName(marks)


def _dealt(turns: DataFrame) -> DataFrame:
    """Each conversation in one task, its turns in order and each mark before its turn."""
    last = _last_sign(F.col("text"))
    turns = turns.withColumns({"blank": last == "", "cut": ~last.isin(".", "!", "?")})
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "has_turn", "turn", "role", "digest", "kind").select("conv_id", "has_turn", "turn", "role", "kind", "text", "blank", "cut")


class Conversation:
    """What one conversation comes to."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = 0
        self.before = self.low = self.high = None
        self.is_first = False

    def read(self, has_turn: int, turn: int, role: str, kind: int, text: str, blank: bool, cut: bool) -> None:
        if kind < 1:
            self.is_first = kind == 0
            return
        first, self.is_first = self.is_first, False
        again = not blank and not first
        self.blank += blank
        self.duplicate += again
        truncated = not blank and not again and cut
        self.truncated += truncated
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if has_turn:
            if self.low is None:
                self.low = turn
            if self.high != turn:
                self.numbers += 1
            self.high = turn
        self.repair.read(role, text, blank or again, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.numbers
        cost, audit, digest = self.repair.result()
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation
    of rows(conv_id, turn, role, text).  A row whose further column ``gone`` is true names its conversation only."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, talk, out = None, None, []

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done))
            kinds = [key_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if talk is None or conv != now:
                    if talk is not None:
                        out.append((now, *talk.result()))
                    now, talk = conv, Conversation()
                talk.read(*turn)
            if out:
                yield batch_of(out)
                out = []
        if talk is not None:
            yield batch_of([(now, *talk.result())])

    return _dealt(_turns(rows)).mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text: the turns of each conversation after its repair.

    ``verdicts`` is the result of repaired_conversations; its audit goes in front of the conversation's turns in
    the same stream, so nothing is joined."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    audits = verdicts.select("conv_id", F.lit(-1).alias("has_turn"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(-2).alias("kind"), F.col("audit").alias("text"))
    names = ["conv_id", "position", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, position, now = "", 0, 0, 0, None
        for batch in batches:
            out: list[tuple] = []
            key_type = batch.schema.field("conv_id").type

            def inserts() -> None:
                nonlocal at, state, position
                while at < len(audit) and audit[at] == "I":
                    letter = "a" if state == 2 else "u"
                    out.append((now, position, "I", ROLES[letter], ""))
                    at, state, position = at + 1, NEXT[state][letter], position + 1

            for conv, _, _, role, what, text, _, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if what == -2:
                    audit, at, state, position, now = text, 0, 0, 0, conv
                    inserts()
                elif what == 1:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        letter = role[:1] if edit == "K" else "a" if state == 2 else "u"
                        out.append((conv, position, edit, role if edit == "K" else ROLES[letter], text))
                        state, position = NEXT[state][letter], position + 1
                    inserts()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [key_type, pa.int64(), pa.string(), pa.string(), pa.string()])], names=names)

    turns = _turns(rows).unionByName(audits)
    return _dealt(turns).mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults planted by the check sum of conversation and turn; a dropped
    row stays with ``gone`` set."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies.alias("copy")).drop("copy")
