"""Conversation structure repair: Wagner-Fischer alignment to the alternating grammar.

A well-formed conversation has the role initials ``(s?(ua)+)?``: an optional system turn, then
user and assistant in turn.  For each length there is one target string per ending, so the
cheapest repair is the least of the alignments of the turns to each feasible length.  A target
is a suffix of every longer one with the same ending: one Wagner-Fischer table, read from the
back, therefore holds the alignments to all its lengths.  Cells off the Ukkonen band, which
could only belong to a script dearer than the incumbent's, are never filled.  Every alignment
that reaches the least cost is traced back and the audits (the edits' initials) are compared.

Turns are aligned in blocks of ``BLOCK`` rows.  A block meets the next one in one of four
states (nothing put out, a lone system turn, user due, assistant due), so the cost that remains
behind a block is four numbers, and a conversation of any length needs tables of one block only.

``damage`` makes faults to be repaired; ``repair`` works on any table of turns.  Both run as one
shuffle by conversation.  In each task the turns come as a sorted stream, first as codes (one
byte a turn is kept), then with their texts, which are hashed and let go.  Duplicates are found
by a window over (conversation, role, SHA-256 of the text).  A conversation's audit and hash are
one sequence, so one task reads a conversation; what it holds is the audit, never the texts.

Defined cases: a null role or text counts as one space (blank, no known role); null turns come
first and have no part in ``gaps``; equal turns are ordered by role, then by the SHA-256 of the
text, then as repeated; a null ``conv_id`` is one conversation of its own; repeated rows are
duplicates; a conversation without turns has zeros, an empty audit and the hash of an empty
string; other roles than system, user and assistant count by their initial (an unknown initial
can be reroled or deleted); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caremart.llm.common import slices

BLOCK = 64
INF = 1 << 60
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs; a truncated turn that stays adds the last

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# States between two edits; the last two are due characters of the alternation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
END = (0, INF, 0, INF)  # cost that remains at the end of the conversation: the accepting states

RESULT = ("conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


# -- alignment ----------------------------------------------------------------

# A turn's code: its initial (s, u, a or ?), upper case if it ends truncated, or - for a turn
# that must go (blank or duplicate).

def _fit(code: str, wanted: str) -> int:
    """Cost of letting a turn stand for a wanted initial."""
    if code == "-":
        return INF
    cost = 0 if code.lower() == wanted else REROLE
    return cost + TRUNCATED if code.isupper() or code == "!" else cost


def _wanted(ending: int, left: int) -> str:
    """First initial of the target with ``left`` initials that leaves ``ending`` due."""
    return "ua"[(left + (ending == ASSISTANT)) % 2]


def _start(state: int) -> str:
    return "a" if state == ASSISTANT else "u"


def _greedy(codes: str, state: int, behind: tuple[int, ...], last: bool) -> int:
    """Cost of an incumbent: every turn that may stand does, or all go."""
    finish = (0, 2 * INSERT, 0, INSERT) if last else behind  # the last block may end with inserts
    cost, wanted, after = 0, _start(state), state
    for c in codes:
        if c == "-":
            cost += DELETE
        else:
            cost += _fit(c, wanted)
            wanted, after = ("a", ASSISTANT) if wanted == "u" else ("u", USER)
    return min(cost + finish[after], DELETE * len(codes) + finish[state])


class _Table:
    """Costs of aligning the turns from each one on to every length of one ending's targets."""

    def __init__(self, codes: str, ending: int, last: bool, budget: int):
        self.codes, self.ending, self.last = codes, ending, last
        n = len(codes)
        self.width = n + budget // INSERT  # longer targets need more inserts than the incumbent affords
        below = [INSERT * r if last and INSERT * r <= budget else INF for r in range(self.width + 1)]
        below[0] = 0
        self.rows = [below]
        for i in range(n - 1, -1, -1):
            least = max(0, n - i - budget // DELETE)
            most = min(self.width, n - i + budget // INSERT)
            row = [INF] * (self.width + 1)
            for r in range(least, most + 1):
                best = DELETE + below[r]
                if r:
                    best = min(best, INSERT + row[r - 1],
                               _fit(codes[i], _wanted(ending, r)) + below[r - 1])
                row[r] = best
            self.rows.append(row)
            below = row
        self.rows.reverse()

    def trace(self, i: int, r: int) -> str:
        """The ASCII-least cheapest audit: D before I before K before R."""
        audit = []
        while i < len(self.codes) or r:
            cost = self.rows[i][r]
            if i < len(self.codes) and cost == DELETE + self.rows[i + 1][r]:
                audit.append("D")
                i += 1
            elif r and cost == INSERT + self.rows[i][r - 1]:
                audit.append("I")
                r -= 1
            else:
                audit.append("K" if self.codes[i].lower() == _wanted(self.ending, r) else "R")
                i, r = i + 1, r - 1
        return "".join(audit)


@lru_cache(maxsize=1 << 16)
def align(codes: str, behind: tuple[int, ...], last: bool,
          states: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """For each entry state: least cost, its ASCII-least audit and the state behind the block.

    ``behind`` is the cost that remains from each state behind the block.  Only the last block
    may end with inserts; elsewhere they belong to the next block.
    """
    floor = min(behind)
    budget = max(_greedy(codes, s, behind, last) for s in states) - floor
    tables = {e: _Table(codes, e, last, budget) for e in (USER, ASSISTANT)}

    def options(i: int, state: int) -> Iterator[tuple[int, int, int, int]]:
        """(cost, ending, left, state behind) of the alignments of the turns from ``i`` on."""
        for e, t in tables.items():
            for r, cost in enumerate(t.rows[i]):
                if cost >= INF:
                    continue
                if r == 0:
                    if e == USER:  # nothing put out: both tables tell the same
                        yield cost + behind[state], e, 0, state
                elif _wanted(e, r) == _start(state):
                    yield cost + behind[e], e, r, e

    out = []
    for s in states:
        found = [(cost, 0, "", e, r, after) for cost, e, r, after in options(0, s)]
        if s == NOTHING:  # a system turn may open it, once all before it are deleted
            for k, c in enumerate(codes):
                if c.lower() == "s":
                    opened = DELETE * k + _fit(c, "s")
                    found += [(opened + cost, k + 1, "D" * k + "K", e, r, after)
                              for cost, e, r, after in options(k + 1, SYSTEM)]
        least = min((f[0] for f in found), default=INF)
        audits = [(head + tables[e].trace(i, r), after)
                  for cost, i, head, e, r, after in found if cost == least] if least < INF else [("", s)]
        audit, after = min(audits)
        out.append((min(least, INF), audit, after))
    return tuple(out)


def cheapest(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """Least cost and ASCII-least audit of a whole conversation."""
    if not codes:
        return 0, ""
    cuts = [codes[i:i + block] for i in range(0, len(codes), block)]
    everywhere = (NOTHING, SYSTEM, USER, ASSISTANT)
    behind, ahead = END, []
    for at in range(len(cuts) - 1, 0, -1):  # costs that remain, block by block from the back
        ahead.append(behind)
        found = align(cuts[at], behind, at == len(cuts) - 1, everywhere)
        behind = tuple(cost for cost, *_ in found)
    state, total, audit = NOTHING, 0, []
    for at, cut in enumerate(cuts):
        (cost, piece, after), = align(cut, behind, at == len(cuts) - 1, (state,))
        total = total if at else cost
        audit.append(piece)
        state = after
        behind = ahead.pop() if ahead else END
    return total, "".join(audit)


# -- turns ----------------------------------------------------------------------

def damage(turns: DataFrame) -> DataFrame:
    """Deterministic faults by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 sets the role user; nulls become one space.

    A dropped row stays with a null ``role``, so that its conversation is known.
    """
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    return (turns.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("role"),
                         plain("text").alias("text"), kind.alias("kind"))
            .select("conv_id", "turn",
                    F.when(F.col("kind") == 0, F.lit(None)).when(F.col("kind") == 4, "user")
                    .otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def _codes(turns: DataFrame) -> DataFrame:
    """Every row twice: as a code (``step`` 0, no text) and with its text (``step`` 1)."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    cut_off = F.when(F.substring(bare, -1, 1).isin(*ENDS), known) \
        .otherwise(F.when(known == "?", "!").otherwise(F.upper(known)))
    rows = turns.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"),
        F.when(F.col("role").isNull(), "")
        .when(bare == "", "-").otherwise(cut_off).alias("code"), "text")
    texts = rows.filter(F.col("role").isNotNull()).select(F.lit(1).alias("step"), *rows.columns)
    return rows.select(F.lit(0).alias("step"), *rows.columns[:-1], F.lit(None).cast("string").alias("text")).union(texts)


class _Conversation:
    """What one conversation's stream adds up to."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = None
        self.distinct = 0
        self.before: str | None = None
        self.audit: str | None = None
        self.cost = 0
        self.at = 0  # next edit
        self.put = 0  # turns put out
        self.hash = hashlib.sha256()

    def code(self, turn: int | None, role: str | None, code: str, repeated: bool) -> None:
        if role is None:  # a dropped row
            return
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        if code == "-":
            self.counts["blank"] += 1
        elif repeated:
            self.counts["duplicate"] += 1
            code = "-"
        elif code.isupper() or code == "!":
            self.counts["truncated"] += 1
        self.codes += code.encode()

    def settle(self) -> None:
        """All codes are there: choose the edits."""
        codes = self.codes.decode()
        self.cost, self.audit = cheapest(codes)
        length = len(self.audit) - self.audit.count("D")
        self.odd = length % 2  # an odd length opens with a system turn
        self.codes.clear()

    def _role(self) -> str:
        return "user" if (self.put - self.odd) % 2 == 0 else "assistant"

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.put else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.put += 1

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._write(self._role(), "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        if self.audit is None:
            self.settle()
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._write(role if edit == "K" else self._role(), text)

    def row(self) -> tuple:
        if self.audit is None:
            self.settle()
        self.inserts()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv_id, gaps, *self.counts.values(), self.cost, self.audit, self.hash.hexdigest())


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: faults, cheapest cost, audit and the hash of the repaired turns.

    ``turns`` has conv_id, turn, role and text; a row with a null role is no turn, it only makes
    its conversation known.
    """
    kind = turns.schema["conv_id"].dataType
    seen = Window.partitionBy("conv_id", "step", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    rows = (_codes(turns).repartition("conv_id")
            .withColumn("repeated", F.row_number().over(seen) > 1)
            .sortWithinPartitions("conv_id", "step", F.asc_nulls_first("turn"), "role", "digest", "repeated")
            .select("conv_id", "step", "turn", "role", "code", "repeated", "text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        now: _Conversation | None = None
        id_type = None

        def batch(done: list[tuple]) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)],
                                              names=names)

        for b in slices(batches):
            id_type = b.schema.field(0).type
            done = []
            for conv_id, step, turn, role, code, repeated, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                if step == 0:
                    now.code(turn, role, code, repeated)
                else:
                    now.text(role, text)
            if done:
                yield batch(done)
        if now is not None:
            yield batch([now.row()])

    return rows.mapInArrow(stream, RESULT.format(id=kind.simpleString()))
