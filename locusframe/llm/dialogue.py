"""Conversation structure repair (operator 11): the cheapest edits that give a conversation legal roles, as one integer-minimum DP.

A repaired conversation has role initials (s?(ua)+)?. A row is kept (0), given the role user or assistant (1) or deleted (2); an
empty user or assistant row may be inserted anywhere (5); blank rows and duplicates must go; a truncated row that stays adds 5.

Weights are single integers: the high digits carry the cost, and below them every row owns three octal digits for the edits up to and
including its own (two inserts before a row suffice, since three end where one does), as letters D, I, K, R = 1, 2, 3, 4, left-aligned
and zero-padded. A row's own letter ends its digits, so two audits never differ first where one has padding, and the smaller integer is
the smaller audit; only the very end pads with zeros. So an ordinary minimum over a DAG of four states (nothing yet, after s, u, a)
settles cost and ties at once.

The rows of one conversation may be a third of the table, so none is gathered: rows without their texts (a 128-bit hash stands for
them) are range-partitioned by conversation and place, cut into chunks of at most `chunk` rows, and a chunk becomes a 4 x 4 table of
weights from start to end state. The chunks of a conversation are then joined from the last to the first; the digits of all later
chunks count only by their rank among the four states, so the integers never outgrow a chunk. Texts are shuffled once, by conversation
and place, and stream through the hash. What one conversation needs whole is its audit, a letter a row, since it is one value.

Defined results: null ids are one conversation; null turns come first; rows of one turn are ordered by role, then by the first 32
characters of the text, then by its hash; repeated rows are duplicates; null roles and texts are one space (a role that can't be kept,
and a blank text); very long texts are used whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = " DIKR"  # ascending, so digits compare as letters do
STATES = range(4)  # 0: nothing yet, then after s, u, a
ALTERNATE = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after an inserted or re-roled row
LEGAL_START = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: What is still to insert at the end of a conversation, by state; an end in s costs a user and an assistant.
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
SLOT = 9  # bits: three octal digits a row
KEY = ["conv", "turn", "role", "lead", "h"]


def _slot(letters: str) -> int:
    return sum(LETTERS.index(c) << (SLOT - 3 * k - 3) for k, c in enumerate(letters))


def _letters(slot: int) -> str:
    return "".join(LETTERS[(slot >> (SLOT - 3 * k - 3)) & 7] for k in range(3)).strip()


def row_table(initial: str, truncated: bool, gone: bool) -> dict[tuple[int, int], tuple[int, int]]:
    """(state before, after) -> least (cost, digits) of a row's edits, inserts before it included."""
    best: dict[tuple[int, int], int] = {}
    for start, inserts in product(STATES, range(3)):
        at = start
        for _ in range(inserts):
            at = ALTERNATE[at]
        ends = [(at, "D", DELETE)]
        if not gone:
            extra = TRUNCATED * truncated
            ends.append((ALTERNATE[at], "R", REROLE + extra))
            if at in LEGAL_START.get(initial, {}):
                ends.append((LEGAL_START[initial][at], "K", KEEP + extra))
        for end, letter, cost in ends:
            w = (cost + INSERT * inserts) << SLOT | _slot("I" * inserts + letter)
            best[start, end] = min(w, best.get((start, end), w))
    return {k: (w >> SLOT, w & ((1 << SLOT) - 1)) for k, w in best.items()}


#: By kind: 0 for rows that must go, else 1 + 2 * (place of the initial in "sua", 3 for others) + truncated.
TABLES = [row_table("", False, True)] + [row_table(i, t, False) for i in ("s", "u", "a", "") for t in (False, True)]


def transfer(kinds: list[int], starts=STATES) -> dict[tuple[int, int], int]:
    """(start, end) -> least weight of a chunk's rows; cost << (9 * rows) | digits."""
    n, out = len(kinds), {}
    for s in starts:
        w = {s: 0}
        for i, kind in enumerate(kinds):
            down, nxt = SLOT * (n - 1 - i), {}
            for (a, b), (cost, digits) in TABLES[kind].items():
                if a in w:
                    x = w[a] + (cost << (SLOT * n)) + (digits << down)
                    if b not in nxt or x < nxt[b]:
                        nxt[b] = x
            w = nxt
        out.update({(s, e): x for e, x in w.items()})
    return out


class Path:
    """The cheapest way through a conversation's chunks, added from the last to the first; four weights a chunk are kept."""

    def __init__(self):
        self.ahead = {q: (INSERT * len(t), len(t)) for q, t in TAIL.items()}  # cost and rank of all that follows, by state
        self.best: list[tuple[int, dict[int, tuple[int, int]]]] = []

    def add(self, n: int, weights: dict[tuple[int, int], int]) -> None:
        """A chunk of n rows: its digits, then the rank of what follows, are the low digits of one integer."""
        low, found = SLOT * n, {}
        for (s, e), w in weights.items():
            cost, rank = self.ahead[e]
            x = (w + (cost << low)) << 2 | rank
            if s not in found or x < found[s][0]:
                found[s] = (x, e)
        digits = {s: x & ((4 << low) - 1) for s, (x, _) in found.items()}
        order = sorted(set(digits.values()))
        self.best.append((n, found))
        self.ahead = {s: (x >> (low + 2), order.index(digits[s])) for s, (x, _) in found.items()}

    def walk(self):
        """(start state, end state, letters by row) of every chunk, first one first."""
        at = 0
        for n, found in reversed(self.best):
            x, end = found[at]
            yield at, end, [_letters((x >> (2 + SLOT * (n - 1 - i))) & ((1 << SLOT) - 1)) for i in range(n)]
            at = end


def plans(start: int, slots: list[str], kinds: list[int]) -> list[str]:
    """Per row what comes out: u or a for an inserted row, U or A for the row with a new role, K for the row as it is, D for none."""
    at, out = start, []
    for letters, kind in zip(slots, kinds, strict=True):
        said = ""
        for c in letters:
            if c == "K":
                at = LEGAL_START["sua"[(kind - 1) // 2]][at]
            elif c != "D":
                at = ALTERNATE[at]
            said += {"I": " ua"[at - 1], "R": " UA"[at - 1]}.get(c, c)
        out.append(said)
    return out


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of "conv_id:turn" modulo 20 (null: one space in any column): 0 dropped, 1 emptied, 2 without [.!?], 3 repeated, 4 by the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    d = rows.select(F.col("conv_id"), F.col("turn"), blank("role").alias("_r"), blank("text").alias("text"), k.alias("_k")).where("_k <> 0")
    d = d.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("_r")).alias("role"), text.alias("text"), "_k")
    return d.withColumn("_n", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_k", "_n")


def _keyed(rows: DataFrame) -> DataFrame:
    """conv, turn, role, lead, h, text: what orders and names a row, and its text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text = blank("text")
    return rows.select(blank("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), F.substring(text, 1, 32).alias("lead"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("h"), text.alias("text"))


def _has_word() -> Column:
    return F.col("text").rlike(r"[^\x20\x09-\x0D]")


def faults(rows: DataFrame) -> DataFrame:
    """One row a row, without its text: KEY, copy, fault (blank, duplicate, truncated or empty), initial and kind."""
    k = _keyed(rows).withColumns({"blank": ~_has_word(), "ended": F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})
    k = k.groupBy(*KEY, "blank", "ended").agg(F.count("*").alias("n"))
    first = k.groupBy("conv", "role", "h").agg(F.min(F.struct("turn")).alias("first"), F.sum("n").alias("all")).where("all > 1").drop("all")
    k = k.join(first, ["conv", "role", "h"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    seen = (F.col("copy") > 1) | (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn")))
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * place + (F.col("fault") == "truncated").cast("int"))
    return k.select(*KEY, "copy", fault.alias("fault"), initial.alias("initial")).withColumn("kind", kind.cast("int"))


def _chunks(chunk: int):
    """Sorted rows to chunks: their weights, and the illegal neighbours inside them."""

    def close(conv, at, kinds, initials, first):
        w = transfer(kinds, (0,) if first else STATES)
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        raw = [w[s, e].to_bytes((w[s, e].bit_length() + 7) // 8, "big") if (s, e) in w else None for s in STATES for e in STATES]
        return conv, at, bytes(kinds), initials[0], initials[-1], bad, raw

    def run(batches):
        open_, last_at, last_conv = None, None, None
        names = ["conv", "first_at", "kinds", "first_initial", "last_initial", "illegal", "weights"]
        for b in batches:
            out = []
            for conv, at, kind, initial in zip(b["conv"], b["at"], b["kind"], b["initial"], strict=True):
                follows = last_at is not None and at == last_at + 1
                if open_ is None or not follows or conv != open_[0] or len(open_[2]) >= chunk:
                    if open_ is not None:
                        out.append(close(*open_))
                    # A conversation that begins right after another one's row begins here; else the chunk may continue one.
                    open_ = (conv, at, [], [], follows and conv != last_conv)
                open_[2].append(kind)
                open_[3].append(initial)
                last_at, last_conv = at, conv
            yield pd.DataFrame(out, columns=names)
        if open_ is not None:
            yield pd.DataFrame([close(*open_)], columns=names)

    return run


CHUNKS = "conv string, first_at bigint, kinds binary, first_initial string, last_initial string, illegal bigint, weights array<binary>"
JOINED = "conv string, first_at bigint, plan array<string>, cost bigint, illegal bigint, audit string"


def _join(batches):
    """Chunks sorted by conversation and falling place: one row a chunk with its rows' plans, and one a conversation with cost and audit."""

    def close(conv, path, kept):
        kept, audit, rows = kept[::-1], [], []
        bad = sum(k[4] for k in kept) + sum(x[3] + y[2] not in ("su", "ua", "au") for x, y in zip(kept, kept[1:], strict=False))
        for (at, kinds, *_), (start, end, slots) in zip(kept, path.walk(), strict=True):
            audit += slots
            rows.append([conv, at, plans(start, slots, kinds), None, None, None])
        tail = TAIL[end]
        rows[-1][2][-1] += {"": "", "I": "a", "II": "ua"}[tail]
        return [*rows, [conv, None, None, path.ahead[0][0], bad, "".join(audit) + tail]]

    now, path, kept = None, Path(), []
    columns = ["conv", "first_at", "plan", "cost", "illegal", "audit"]
    frame = lambda out: pd.DataFrame(out, columns=columns).astype({"first_at": "Int64", "cost": "Int64", "illegal": "Int64"})
    for b in batches:
        out = []
        for conv, at, kinds, a, z, bad, raw in zip(*[b[c] for c in ("conv", "first_at", "kinds", "first_initial", "last_initial", "illegal", "weights")], strict=True):
            if kept and conv != now:
                out += close(now, path, kept)
                path, kept = Path(), []
            now = conv
            path.add(len(kinds), {(i // 4, i % 4): int.from_bytes(x, "big") for i, x in enumerate(raw) if x is not None})
            kept.append((at, kinds, a, z, bad))
        yield frame(out)
    if kept:
        yield frame(close(now, path, kept))


ROLES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}


def _turns(digest: bool):
    """Texts and plans in order of place to the repaired rows, or to one hash a conversation."""

    def run(batches):
        now, key, text, seq, sha = None, None, "", 0, hashlib.sha256()
        for b in batches:
            out = []
            for conv, turn, role, h, tag, said, plan in zip(*[b[c] for c in ("conv", "turn_key", "role", "h", "tag", "text", "plan")], strict=True):
                if conv != now:
                    if digest and now is not None:
                        out.append((now, sha.hexdigest()))
                    now, key, seq, sha = conv, None, 0, hashlib.sha256()
                if tag == 0:
                    key, text = (turn, role, h), said
                    continue
                for c in plan:
                    if c == "D":
                        continue
                    own = c in "KUA"
                    if own and key != (turn, role, h):
                        raise ValueError("a kept row has lost its text")
                    row = (role if c == "K" else ROLES[c], text if own else "")
                    if digest:
                        sha.update((("\n" if seq else "") + f"{row[0]}:{row[1]}").encode("utf-8", "surrogatepass"))
                    else:
                        out.append((conv, seq, *row, {"K": "keep", "U": "rerole", "A": "rerole"}.get(c, "insert")))
                    seq += 1
            yield pd.DataFrame(out, columns=["conv", "sha"] if digest else ["conv", "position", "role", "text", "edit"])
        if digest and now is not None:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=["conv", "sha"])

    return run


class Repair:
    """The repair of a table (conv_id, turn, role, text): found once, then read as per-conversation figures or as repaired rows."""

    def __init__(self, rows: DataFrame, chunk: int = 256):
        self.rows = rows
        order = [*KEY, "copy"]
        self.faults = written(faults(rows), "dialogue-faults")
        placed = self.faults.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        self.placed = written(placed, "dialogue-places")
        parts = self.placed.select("conv", "at", "kind", "initial").mapInPandas(_chunks(chunk), CHUNKS)
        self.joined = written(parts.repartition("conv").sortWithinPartitions("conv", F.desc("first_at")).mapInPandas(_join, JOINED), "dialogue-plans")

    def _ordered(self) -> DataFrame:
        """Texts (tag 0) and plans (tag 1) by conversation, in order of place."""
        plan = self.joined.where("first_at is not null").select("first_at", F.posexplode("plan").alias("i", "plan"))
        plan = plan.select((F.col("first_at") + F.col("i")).alias("at"), "plan").where("plan <> 'D'")
        plan = self.placed.join(plan, "at").select(*KEY, "at", F.lit(1).alias("tag"), F.lit(None).cast("string").alias("text"), "plan")
        said = _keyed(self.rows).where(_has_word()).select(*KEY, F.lit(-1).cast("bigint").alias("at"), F.lit(0).alias("tag"), "text", F.lit(None).cast("string").alias("plan"))
        d = said.unionByName(plan).repartition("conv").sortWithinPartitions(*KEY, "tag", "at")
        return d.select("conv", F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turn_key"), "role", "h", "tag", "text", "plan")

    def turns(self) -> DataFrame:
        """conv_id, position, role, text, edit (keep, rerole or insert) of every repaired row."""
        d = self._ordered().mapInPandas(_turns(False), "conv string, position bigint, role string, text string, edit string")
        return d.select(_id(), "position", "role", "text", "edit")

    def figures(self, ids: DataFrame | None = None) -> DataFrame:
        """One row a conversation of ids (conv_id; default: of the table): gaps, faults, cost, audit and the hash of the repaired rows."""
        wide = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count_distinct("turn")
        counts = self.faults.groupBy("conv").agg(wide.try_cast("bigint").alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
        sha = self._ordered().mapInPandas(_turns(True), "conv string, sha string")
        own = self.joined.where("first_at is null").select("conv", "illegal", "cost", "audit")
        every = (self.rows if ids is None else ids).select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
        d = every.join(counts, "conv", "left").join(own, "conv", "left").join(sha, "conv", "left")
        zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return d.select(_id(), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _id() -> Column:
    return F.when(F.col("conv") != " ", F.col("conv")).cast("bigint").alias("conv_id")


def op11_dialogue_repair(conversations: DataFrame) -> DataFrame:
    """The contract's query: damage the table, repair it, return a row for every original conversation."""
    return Repair(damage(conversations)).figures(conversations)
