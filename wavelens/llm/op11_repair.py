"""Conversation structure repair by grammar-compressed min-plus dynamic programming.

A conversation is legal if the initials of its roles match ``(s?(ua)+)?``. The cheapest
edits that make it so are found by a dynamic program over four states (nothing yet, after
s, after u, after a). Every row is a symbol made of its role's initial and its fault:

* ``blank``: no character outside ``\\x20\\x09-\\x0D``;
* ``duplicate``: role and text stood earlier in the conversation;
* ``truncated``: the last such character is none of ``.!?``; the first fault counts.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and
duplicate rows), Insert a user or assistant with empty text 3, and 3 more for each
truncated row that stays. The audit is the edits' initials in order; of equally cheap ones
the ASCII-least is taken.

A symbol's transfer matrix gives for each pair of states the cost of the cheapest edits
between them, inserts before the row included. Within one pair of states the audits of
a sequence are never prefixes of each other when they end at different states, so the
order of two audits is decided by their left parts: a matrix carries the rank of its
audits beside the cost, products compare costs, then ranks, and note the state in the
middle. These middle states are the audit's rope: a rule's audit is the concatenation
of its two symbols' audits, written out only where asked.

``repair`` sorts the rows of all conversations by ranges (one conversation may take many
partitions) and cuts them to blocks of at most ``BLOCK`` rows. A task compresses the
distinct symbol sequences of its blocks with Re-Pair, one matrix per rule, evaluated
bottom-up and shared by all conversations of the batch. A conversation's blocks are then
joined by their 4 x 4 matrices alone, one small row for each ``BLOCK`` rows. Texts are
compared by 128-bit digests, and are not part of the sorted rows.

Rows are taken by turn (null first), then role and digest; equal rows are counted before
the shuffle, so a row that is repeated a billion times is one row with a number. Null role
or text is one space, a role without a first character fits no place of the grammar (it is
reroled or deleted), a null ``conv_id`` is a conversation of its own. Empty tables give no
rows; only the four columns are read. An audit is a string, so a conversation may have
2^31 rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelens.llm.store import stage

BLOCK = 4096                    # rows of a block
BATCH = 1 << 16                 # rows whose sequences share a grammar
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}    # state after a rerole or an insert
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
CLOSING = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}                  # inserts needed at the end
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
ROLES = {USER: "user", ASSISTANT: "assistant"}
GONE = "x"                      # symbol of a row that must be deleted
SYMBOLS = GONE + "suao" + "SUAO"                # capitals: truncated
POWERS = 40                     # symbols for 2, 4, 8, ... deletions in a row
INFINITE = 1 << 50
#: states between two of which a matrix has an entry
PAIRS = [(i, j) for i in range(4) for j in range(4)]


# ------------------------------------------------------------- matrices

def symbol_matrix(symbol: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest (cost, audit) from state to state over the inserts before a row and its edit."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for i in range(4):
        state = i
        for inserts in range(3):
            edits = [(DELETE, "D", state)]
            if symbol != GONE:
                stays = CUT if symbol.isupper() else 0
                edits.append((REROLE + stays, "R", NEXT[state]))
                if state in KEEP[symbol.lower()]:
                    edits.append((stays, "K", KEEP[symbol.lower()][state]))
            for cost, letter, j in edits:
                got = (inserts * INSERT + cost, "I" * inserts + letter)
                out[i, j] = min(out.get((i, j), got), got)
            state = NEXT[state]
    return out


def product(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray):
    """(costs, ranks, middle states) of the products of n pairs of matrices, n x 4 x 4."""
    total = ca[:, :, :, None] + cb[:, None, :, :]                       # n, from, middle, to
    mid = (total * 4 + ra[:, :, :, None]).argmin(axis=2)
    cost = np.minimum(np.take_along_axis(total, mid[:, :, None, :], 2)[:, :, 0], INFINITE)
    right = np.take_along_axis(np.broadcast_to(rb[:, None], total.shape), mid[:, :, None, :], 2)[:, :, 0]
    order = np.where(cost < INFINITE, np.take_along_axis(ra, mid, 2) * 4 + right, 16)
    return cost, order.argsort(axis=2, kind="stable").argsort(axis=2, kind="stable"), mid


class Grammar:
    """Re-Pair rules over symbol sequences, with a matrix and a rope for each rule."""

    def __init__(self):
        letters = [symbol_matrix(s) for s in SYMBOLS]
        self.letters = [{k: audit for k, (_, audit) in m.items()} for m in letters]
        cost = np.full((len(letters), 4, 4), INFINITE, np.int64)
        rank = np.zeros((len(letters), 4, 4), np.int64)
        for n, m in enumerate(letters):
            for i in range(4):
                ends = sorted((m[i, j][1], j) for j in range(4) if (i, j) in m)
                for r, (_, j) in enumerate(ends):
                    cost[n, i, j], rank[n, i, j] = m[i, j][0], r
        self.cost, self.rank = cost, rank
        self.mid = np.zeros((len(letters), 4, 4), np.int64)
        self.left = self.right = np.full(len(letters), -1, np.int64)
        power = SYMBOLS.index(GONE)
        self.powers = [power]
        for _ in range(POWERS):
            power = int(self.add(np.array([power]), np.array([power]))[0])
            self.powers.append(power)

    def add(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """New rules for pairs of symbols, their matrices from those below."""
        cost, rank, mid = product(self.cost[left], self.rank[left], self.cost[right], self.rank[right])
        at = len(self.cost) + np.arange(len(left))
        self.cost, self.rank = np.concatenate([self.cost, cost]), np.concatenate([self.rank, rank])
        self.mid = np.concatenate([self.mid, mid])
        self.left, self.right = np.concatenate([self.left, left]), np.concatenate([self.right, right])
        return at

    def deletions(self, n: int) -> list[int]:
        """Symbols for ``n`` rows in a row that must go."""
        return [p for k, p in enumerate(self.powers) if n >> k & 1]

    def compress(self, sequences: list[list[int]]) -> np.ndarray:
        """Rule of each sequence (none empty)."""
        lens = np.array([len(s) for s in sequences])
        seq = np.concatenate([np.array(s, np.int64) for s in sequences])
        owner = np.repeat(np.arange(len(sequences)), lens)
        while len(seq) > len(sequences):        # frequent pairs first, while any repeats
            same = np.flatnonzero(owner[1:] == owner[:-1])
            codes, counts = np.unique(seq[same] * len(self.cost) + seq[same + 1], return_counts=True)
            chosen, used = [], set()
            for at in np.argsort(-counts, kind="stable")[:256]:
                a, b = divmod(int(codes[at]), len(self.cost))
                if counts[at] < 2 or counts[at] * 2 < counts.max():
                    break
                if not used & {a, b}:           # pairs without a common symbol never overlap
                    used |= {a, b}
                    chosen.append((a, b))
            if not chosen:
                break
            seq, owner = self._replace(seq, owner, np.array(chosen))
        while len(seq) > len(sequences):        # what is left, by halves
            place = np.arange(len(seq)) - np.searchsorted(owner, owner)
            at = np.flatnonzero((owner[1:] == owner[:-1]) & (place[:-1] % 2 == 0))
            pairs, which = np.unique(np.stack([seq[at], seq[at + 1]], 1), axis=0, return_inverse=True)
            seq[at] = self.add(pairs[:, 0], pairs[:, 1])[which.reshape(-1)]
            seq, owner = np.delete(seq, at + 1), np.delete(owner, at + 1)
        return seq

    def _replace(self, seq: np.ndarray, owner: np.ndarray, pairs: np.ndarray):
        partner = np.full(len(self.cost), -1, np.int64)
        partner[pairs[:, 0]] = pairs[:, 1]
        rule = np.full(len(self.cost), -1, np.int64)
        rule[pairs[:, 0]] = self.add(pairs[:, 0], pairs[:, 1])
        at = np.flatnonzero((partner[seq[:-1]] == seq[1:]) & (owner[1:] == owner[:-1]))
        # in a run of one symbol every second pair is taken
        first = np.concatenate([[True], np.diff(at) != 1])
        number = np.arange(len(at))
        at = at[(number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0]
        seq[at] = rule[seq[at]]
        return np.delete(seq, at + 1), np.delete(owner, at + 1)

    def audit(self, rule: int, i: int, j: int) -> str:
        """The rope of (rule, i, j), written out."""
        out, todo = [], [(rule, i, j)]
        while todo:
            n, i, j = todo.pop()
            if n < len(self.letters):
                out.append(self.letters[n][i, j])
            else:
                k = int(self.mid[n, i, j])
                todo += [(int(self.right[n]), k, j), (int(self.left[n]), i, k)]
        return "".join(out)


def step(costs: list[int], ranks: list[int], cost: list[int], rank: list[int]) -> tuple[list, list, list]:
    """Row vector of a conversation's beginning times a block's matrix: (costs, ranks, middles)."""
    mids = [min(range(4), key=lambda k: (costs[k] + cost[4 * k + j], ranks[k])) for j in range(4)]
    new = [min(costs[k] + cost[4 * k + j], INFINITE) for j, k in enumerate(mids)]
    order = sorted((j for j in range(4) if new[j] < INFINITE), key=lambda j: (ranks[mids[j]], rank[4 * mids[j] + j]))
    return new, [order.index(j) if j in order else 4 for j in range(4)], mids


# ---------------------------------------------------------------- blocks

_LISTS = {"cost": pa.list_(pa.int64()), "rank": pa.list_(pa.int64()), "audits": pa.list_(pa.string()),
          "known": pa.list_(pa.bool_()), "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()),
          "keys": pa.list_(pa.binary()), "gone": pa.list_(pa.int64())}
_BLOCK_ARROW = pa.schema([("conv", pa.string()), ("block", pa.int64()),
                          *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "distinct",
                                                      "first_turn", "last_turn")),
                          ("first_initial", pa.string()), ("last_initial", pa.string()), *_LISTS.items()])
_BLOCK_DDL = ("conv string, block long, blank long, duplicate long, truncated long, illegal long, distinct long, "
              "first_turn long, last_turn long, first_initial string, last_initial string, cost array<long>, "
              "rank array<long>, audits array<string>, known array<boolean>, turns array<long>, roles array<string>, "
              "keys array<binary>, gone array<long>")
BLANK, TRUNCATED, FINE = 0, 1, 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition to blocks of one conversation each, with their matrices.

    ``keys`` and its neighbours have the rows that may stay; ``gone`` has one more entry: the
    number of rows that must go before each of them, and after the last."""
    def new(conv: str, number: int, head: bool) -> dict:
        return {"conv": conv, "block": number, "head": head, "n": 0, "symbols": [], "blank": 0, "duplicate": 0,
                "truncated": 0, "illegal": 0, "distinct": 0, "first_turn": None, "last_turn": None,
                "first_initial": None, "last_initial": None, "known": [], "turns": [], "roles": [], "keys": [], "gone": [0]}

    def finish(held: list[dict]) -> pa.RecordBatch:
        grammar, known, todo = Grammar(), {}, []
        for b in held:
            seq = []
            for n, s in zip(b["gone"], [*b.pop("symbols"), None]):
                seq += grammar.deletions(n) + ([] if s is None else [SYMBOLS.index(s)])
            b["seq"] = tuple(seq)
            if b["seq"] not in known:
                known[b["seq"]] = len(todo)
                todo.append(seq)
        rules, audits = grammar.compress(todo), {}
        for b in held:
            rule, head = int(rules[known[b.pop("seq")]]), b.pop("head")
            if (rule, head) not in audits:
                # a conversation that begins in this partition has only one state to begin with
                audits[rule, head] = [grammar.audit(rule, i, j) if grammar.cost[rule, i, j] < INFINITE
                                      and (i == START or not head) else None for i, j in PAIRS]
            b.update(cost=grammar.cost[rule].ravel().tolist(), rank=grammar.rank[rule].ravel().tolist(),
                     audits=audits[rule, head])
            b.pop("n")
        return pa.RecordBatch.from_pylist(held, schema=_BLOCK_ARROW)

    held, size, number, begun = [], 0, 0, False
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv", "known", "turn", "role", "key", "state", "n", "first", "part")]
        for conv, known, turn, role, key, state, n, first, part in zip(*cols):
            b = held[-1] if held else None
            if b is None or b["conv"] != conv or b["n"] >= BLOCK:
                if size >= BATCH:
                    yield finish(held)
                    held, size = [], 0
                # the conversation before is known to have ended, unless this is the partition's first
                head = begun and (b is None or b["conv"] != conv) and conv != last
                b = new(conv, part << 32 | number, head)
                number += 1
                held.append(b)
            begun, last, initial = True, conv, role[:1]
            if b["n"]:
                b["illegal"] += b["last_initial"] + initial not in ("su", "ua", "au")
            else:
                b["first_initial"] = initial
            b["illegal"] += n - 1
            b["last_initial"] = initial
            if known:
                b["distinct"] += turn != b["last_turn"]
                b["first_turn"] = turn if b["first_turn"] is None else b["first_turn"]
                b["last_turn"] = turn
            b["n"] += 1
            size += 1
            if state == BLANK:
                b["blank"] += n
                b["gone"][-1] += n
                continue
            b["duplicate"] += n - first
            if first:
                letter = initial if initial in ("s", "u", "a") else "o"
                b["truncated"] += state == TRUNCATED
                b["symbols"].append(letter.upper() if state == TRUNCATED else letter)
                b["known"].append(known)
                b["turns"].append(turn)
                b["roles"].append(role)
                b["keys"].append(key)
                b["gone"].append(0)
            b["gone"][-1] += n - first
    if held:
        yield finish(held)


_PATH_DDL = ("block long, entry int, leave int, tail int, total array<long>")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of their conversations to the states they are entered and left in.
    ``total`` (last block only): gaps, blank, duplicate, truncated, illegal, cost."""
    schema = pa.schema([("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("tail", pa.int32()),
                        ("total", pa.list_(pa.int64()))])

    def finish() -> list[dict]:
        end = min(range(4), key=lambda j: (costs[j] + CLOSING[j] * INSERT, ranks[j]))
        gaps = 0 if low is None else high - low + 1 - distinct
        total = [gaps, *(sums[c] for c in ("blank", "duplicate", "truncated", "illegal")), costs[end] + CLOSING[end] * INSERT]
        out, state, tail = [], end, CLOSING[end]
        for block, mids in reversed(trail):
            out.append({"block": block, "entry": mids[state], "leave": state, "tail": tail, "total": total})
            state, tail, total = mids[state], 0, None
        return out

    conv, trail, ready = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["conv"] != conv or not trail:
                if trail:
                    ready += finish()
                conv, trail, sums = r["conv"], [], defaultdict(int)
                costs, ranks, low, high, distinct, initial = [0] + [INFINITE] * 3, [0, 1, 2, 3], None, None, 0, None
            costs, ranks, mids = step(costs, ranks, r["cost"], r["rank"])
            trail.append((r["block"], bytes(mids)))
            for c in ("blank", "duplicate", "truncated", "illegal"):
                sums[c] += r[c]
            if initial is not None:
                sums["illegal"] += initial + r["first_initial"] not in ("su", "ua", "au")
            initial = r["last_initial"]
            if r["first_turn"] is not None:
                distinct += r["distinct"] - (r["first_turn"] == high)
                low, high = r["first_turn"] if low is None else low, r["last_turn"]
        if len(ready) > 1 << 14:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)
            ready = []
    if trail:
        ready += finish()
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=schema)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their audits to one row for each kept, reroled or inserted row."""
    schema = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("edit", pa.string()),
                        ("role", pa.string()), ("known", pa.bool_()), ("turn", pa.int64()), ("key", pa.binary())])
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            state, row, gone, at = b["entry"], 0, b["gone"][0], 0
            for letter in b["audit"]:
                if letter == "D" and gone:
                    gone -= 1
                    continue
                edit = {"conv": b["conv"], "block": b["block"], "at": at, "edit": letter}
                at += 1
                if letter != "I":
                    edit |= {"known": b["known"][row], "turn": b["turns"][row], "key": b["keys"][row], "role": b["roles"][row]}
                    row += 1
                    gone = b["gone"][row]
                    if letter == "D":
                        continue
                if letter == "K":
                    state = KEEP[edit["role"][:1]][state]
                else:
                    state = NEXT[state]
                    edit["role"] = ROLES[state]
                out.append(edit)
            if len(out) > 1 << 14:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, sha256) of newline-joined lines, sorted by conversation; one line held at a time."""
    conv, state = None, None
    for batch in batches:
        convs, shas = [], []
        for c, line in zip(batch.column("conv").to_pylist(), batch.column("line")):
            if c != conv:
                if state is not None:
                    convs.append(conv)
                    shas.append(state.hexdigest())
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(shas, pa.string())], names=["conv", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["conv", "sha"])


# -------------------------------------------------------------- operator

def plain(rows: DataFrame) -> DataFrame:
    """conv (text of the id, one space if null), known (turn given), turn, role, text."""
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text,
    2 removes ``.!?``, 3 repeats it, 4 makes its role user. Nulls are one space."""
    turn = F.when(F.col("known"), F.col("turn").cast("string")).otherwise(" ")
    fault = F.pmod(F.crc32(F.concat("conv", F.lit(":"), turn)), F.lit(20))
    rows = plain(rows).withColumn("fault", fault).filter("fault <> 0").select(
        "conv", "known", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.select(F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id"),
                       F.when(F.col("known"), F.col("turn")).alias("turn"), "role", "text")


def _faults(rows: DataFrame) -> DataFrame:
    """Counted rows: conv, known, turn, role, key, state, n, and first (1 if the first of its
    copies in the conversation is among the n)."""
    place = ["conv", "known", "turn", "role", "key"]
    inside = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    state = F.when(F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) == 0, BLANK).when(
        inside.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    counted = rows.select(*place, state.cast("int").alias("state")).groupBy(*place).agg(
        F.max("state").alias("state"), F.count(F.lit(1)).alias("n"))
    # n is read here as well, so both uses of the counts are one and the same shuffle
    firsts = (counted.filter(F.col("state") != BLANK).groupBy("conv", "role", "key")
              .agg(F.min(F.struct("known", "turn")).alias("f"), (F.sum("n") * 0).alias("n"))
              .select("conv", "f.known", "f.turn", "role", "key", F.lit(-1).alias("state"), "n", F.lit(1).alias("first")))
    return counted.withColumn("first", F.lit(0)).unionByName(firsts).groupBy(*place).agg(
        F.max("state").alias("state"), F.sum("n").alias("n"), F.max("first").cast("long").alias("first"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired rows) of rows with conv_id, turn, role and text.

    Conversations: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired
    rows: conv, block, at (their order within the conversation), edit, role, text; of a
    deleted row none, of an inserted one an empty text."""
    keyed = plain(rows).withColumn("key", F.unhex(F.md5(F.concat(
        F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))))
    order = ["conv", "known", "turn", "role", "key"]
    blocks = stage(_faults(keyed).repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_blocks, _BLOCK_DDL), "repair-blocks")
    paths = stage(blocks.drop("audits", "known", "turns", "roles", "keys", "gone").repartition("conv")
                  .sortWithinPartitions("conv", "block").mapInArrow(_paths, _PATH_DDL), "repair-paths")
    walked = stage(blocks.join(paths, "block").select(
        "conv", "block", "entry", "known", "turns", "roles", "keys", "gone", "total", F.concat(
            F.element_at("audits", F.col("entry") * 4 + F.col("leave") + 1), F.repeat(F.lit("I"), F.col("tail"))).alias("audit")),
        "repair-audits")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    convs = walked.groupBy("conv").agg(
        F.max("total").alias("total"),
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "audit"))).getField("audit"), "").alias("audit")).select(
        "conv", *(F.col("total")[i].alias(c) for i, c in enumerate(names)), "audit")

    edits = walked.drop("total").mapInArrow(
        _edits, "conv string, block long, at long, edit string, role string, known boolean, turn long, key binary")
    texts = keyed.groupBy("conv", "known", "turn", "key").agg(F.max("text").alias("text"))
    kept = (edits.filter("edit <> 'I'").join(texts, ["conv", "known", "turn", "key"])
            .select("conv", "block", "at", "edit", "role", "text"))
    return convs, kept.unionByName(edits.filter("edit = 'I'").select("conv", "block", "at", "edit", "role", F.lit("").alias("text")))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha) of each conversation's ``role:text`` lines joined by line feeds.

    SHA-256 of a text is one pass from its beginning to its end, so a conversation's
    lines go through one task, sorted (spilling) and streamed, one at a time in memory."""
    return (repaired.select("conv", "block", "at", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv")
            .sortWithinPartitions("conv", "block", "at").select("conv", "line").mapInArrow(_line_digests, "conv string, sha string"))
