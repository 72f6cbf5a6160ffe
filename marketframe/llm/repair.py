"""Repair of conversation structure by the cheapest edits, the least of them in audit order.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``. Rows
are kept (cost 0), get another role (``R``, 2), are deleted (``D``, 3, required for
blank and repeated rows), and empty rows are inserted (``I``, 2); a truncated row
that isn't deleted costs 1 more. The audit is the string of the edits' initials;
among the cheapest repairs the one with the least audit is taken.

Nodes are (row, state), where the state is the role that came last. Costs to the end
come from a dynamic programme over the rows from the last to the first. An arc is
optimal if its cost is the difference of its nodes' costs. Nodes are then ranked by
the first 1, 2, 4, ... edits of their least audits: a rank and a pointer over 2^k
edits combine with those of the node pointed to into the rank and pointer over
2^(k+1). The final ranks choose each node's arc, and the chosen path is collected by
following the doubled pointers from the largest down.

Rows are put in order by a range shuffle and dealt in blocks of ``BLOCK`` rows, so
neither a task nor a numpy array holds a long conversation. What a block of a
conversation does to costs is a 4 by 4 (min, +) matrix; where a conversation has
several blocks, their matrices are combined from the last to the first, then the
states that their chosen paths lead to from the first to the last. That is a few
dozen numbers for each ``BLOCK`` rows. Only a conversation's audit, which is one cell
of the result, and its digest, which is a stream through one task, follow its length.

Edge cases: null roles and texts count as one space, as ``damaged`` has it; rows are
in order of their turns, nulls first; rows of one turn in order of role and a digest
of the text; equal rows stay together and all but the first are repeats. A null
conversation id is a conversation. Roles count by their first character, an empty
one matches nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import saved

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Rows that are worked on at once.
BLOCK = 4096

#: States: nothing yet, after a system, a user, an assistant row; these are the initials too, 0 for any other.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted row, or one with a new role, leads to.
NEXT = (USER, USER, ASSISTANT, USER)
#: What the end costs from each state: an assistant row is missing after a user row, two after a system row.
END = (0, 4, 2, 0)
#: Labels of arcs in the order of their initials; 0 ends the audit.
STOP, DELETE, INSERT, KEEP, REROLE = range(5)
LETTERS = "\0DIKR"
COSTS = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
FAR = 1 << 40


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text``: rows damaged by a hash of id and turn.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's. Nulls count as one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(conv), F.col(turn), shown(role).alias("r"), shown(text).alias("t"),
        (F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20).alias("h"),
    ).where("h <> 0")
    said = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("t", ENDS, "")).otherwise(F.col("t"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select(conv, turn, F.when(F.col("h") == 4, "user").otherwise(F.col("r")).alias(role), said.alias(text), copies.alias("c")).drop("c")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(NONE).cast("int")


def _id(conv: str) -> Column:
    """A conversation's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("-"))


def _ordered(rows: DataFrame) -> DataFrame:
    """``conv, id, turn, initial, fault, at, block`` of ``rows`` (``conv, id, turn, role, text``) in order of conversations and turns.

    fault: 1 blank, 2 repeated, 3 truncated, 0 none; ``at`` counts up in order.
    """
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))
    bare = F.rtrim("text", F.lit(BLANKS))
    marked = rows.select(
        "conv", "id", "turn", "role", _initial(F.col("role")).alias("initial"), F.unhex(F.md5(F.concat(sized("conv"), sized("role"), F.col("text")))).alias("same"),
        (bare == "").alias("blank"), F.substring(bare, -1, 1).isin(*ENDS).alias("ended"),
    )
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id")
    firsts = marked.groupBy("same").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select("same", "first.id")
    repeated = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("id"))
    fault = F.when(F.col("blank"), 1).when(repeated, 2).when(~F.col("ended"), 3).otherwise(0)
    flagged = marked.join(firsts.withColumnRenamed("id", "first_id"), "same", "left")
    along = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("same"), F.col("id")]
    ranged = flagged.select("conv", "id", "turn", "role", "same", "initial", fault.alias("fault")).repartitionByRange(*along).sortWithinPartitions(*along)
    at = saved(ranged.select("conv", "id", "turn", "initial", "fault", F.monotonically_increasing_id().alias("at")), "turns-in-order")
    return at.withColumn("block", F.expr(f"at div {BLOCK}"))


class Block:
    """The pieces of conversations in one block, as arrays; ``ends`` has what follows each piece."""

    def __init__(self, table):
        import numpy as np

        table = table.sort_by("at")
        self.block = table.column("block")[0].as_py()
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        names = table.column("conv").to_pylist()
        self.ids, self.initial, fault = column("id"), column("initial").astype(np.int64), column("fault")
        self.forced, self.extra = (fault == 1) | (fault == 2), (fault == 3).astype(np.int64)
        self.n = len(names)
        fresh = [i for i in range(self.n) if not i or names[i] != names[i - 1]]
        self.starts = np.array(fresh, dtype=np.int64)
        self.stops = np.array([*fresh[1:], self.n], dtype=np.int64)
        self.convs = [names[i] for i in fresh]
        self.piece = np.repeat(np.arange(len(fresh)), self.stops - self.starts)

    def costs(self, ends):
        """Cost to the end from each row and state (rows, 4); ``ends`` (pieces, 4): from each piece's end."""
        import numpy as np

        out = np.empty((self.n, 4), dtype=np.int64)
        now, lengths, step = ends.copy(), self.stops - self.starts, np.array(NEXT)
        for back in range(1, int(lengths.max()) + 1):
            on = np.flatnonzero(lengths >= back)
            i = self.stops[on] - back
            after, first, free = now[on], self.initial[i], ~self.forced[i]
            best = after + COSTS[DELETE]
            touched = np.where(free, self.extra[i], FAR)[:, None]
            best = np.minimum(best, after[:, step] + COSTS[REROLE] + touched)
            best = np.minimum(best, self.kept(after, first) + touched)
            # inserted rows: user and assistant rows lead to each other, the other states to a user row
            user, assistant = best[:, USER].copy(), best[:, ASSISTANT].copy()
            best[:, USER] = np.minimum(user, assistant + COSTS[INSERT])
            best[:, ASSISTANT] = np.minimum(assistant, user + COSTS[INSERT])
            for s in (NONE, SYSTEM):
                best[:, s] = np.minimum(best[:, s], best[:, USER] + COSTS[INSERT])
            out[i], now[on] = best, best
        return out

    @staticmethod
    def kept(after, first):
        """Cost of keeping rows whose initials are ``first``, from each state."""
        import numpy as np

        out = np.full(after.shape, FAR, dtype=np.int64)
        for s in range(4):
            fits = (first == NEXT[s]) | ((first == SYSTEM) & (s == NONE))
            out[fits, s] = after[fits, first[fits]]
        return out

    def arcs(self, ends, last):
        """(targets, labels, costs of nodes): the optimal arcs of all nodes, a column for each label; targets are -1 where there is none.

        Node 4 i + s is row i in state s, after the rows come the pieces' ends. ``last``: pieces that end their conversation.
        """
        import numpy as np

        costs = self.costs(ends)
        all_costs = np.concatenate([costs, ends])
        follows = np.arange(1, self.n + 1)
        follows[self.stops - 1] = self.n + np.arange(len(self.starts))
        targets = np.full((len(all_costs), 4, 5), -1, dtype=np.int64)
        rows, free = np.arange(self.n), ~self.forced
        for s in range(4):
            to = NEXT[s]
            here = costs[:, s]
            put = lambda label, ok, node, s=s: np.copyto(targets[: self.n, s, label], node, where=ok)
            put(DELETE, here == all_costs[follows, s] + COSTS[DELETE], 4 * follows + s)
            put(INSERT, here == costs[:, to] + COSTS[INSERT], 4 * rows + to)
            fits = free & ((self.initial == to) | ((self.initial == SYSTEM) & (s == NONE)))
            put(KEEP, fits & (here == all_costs[follows, self.initial] + self.extra), 4 * follows + self.initial)
            put(REROLE, free & (here == all_costs[follows, to] + self.extra + COSTS[REROLE]), 4 * follows + to)
            tail = np.arange(self.n, len(all_costs))
            more = last & (s in (SYSTEM, USER))
            targets[self.n :, s, INSERT] = np.where(more, 4 * tail + to, -1)
            targets[self.n :, s, STOP] = np.where(more, -1, 4 * tail + s)
        return targets.reshape(-1, 5), all_costs.reshape(-1)

    def pointers(self, targets) -> list:
        """Pointers over 1, 2, 4, ... edits of each node's least audit, until all end."""
        import numpy as np

        nodes = np.arange(len(targets))
        rank = (targets >= 0).argmax(axis=1)  # the least first edit; an edit leads to one node
        over = targets[nodes, rank]
        while True:
            further = over[over]
            rank = np.unique(rank * (len(nodes) + 5) + rank[over], return_inverse=True)[1]
            if np.array_equal(further, over):
                break
            over = further
        order = np.where(targets >= 0, np.arange(5) * len(nodes) + rank[targets], np.iinfo(np.int64).max)
        chosen = [targets[nodes, order.argmin(axis=1)]]
        while not np.array_equal(further := chosen[-1][chosen[-1]], chosen[-1]):
            chosen.append(further)
        return chosen

    def audit(self, entries, ends, last):
        """The nodes of each piece's least path from its entry state in order, with their edits: (pieces, rows or -1, states, labels)."""
        import numpy as np

        targets, costs = self.arcs(ends, last)
        chosen = self.pointers(targets)
        marked = 4 * self.starts + entries
        for over in reversed(chosen):
            marked = np.unique(np.concatenate([marked, over[marked]]))
        row, piece = marked // 4, np.where(marked // 4 < self.n, self.piece[np.minimum(marked // 4, self.n - 1)], marked // 4 - self.n)
        marked = marked[np.lexsort((-costs[marked], row, piece))]
        row = marked // 4
        piece = np.where(row < self.n, self.piece[np.minimum(row, self.n - 1)], row - self.n)
        to = chosen[0][marked]
        label = (targets[marked] == to[:, None]).argmax(axis=1)
        go = label != STOP
        return piece[go], np.where(row < self.n, row, -1)[go], to[go] % 4, label[go]

    def given(self, table, names, default):
        """A value of each piece from columns of ``table``, which has it in every row."""
        import numpy as np

        table = table.sort_by("at")
        found = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(float)[self.starts] for c in names], axis=1)
        return np.where(np.isnan(found), np.array(default, dtype=float), found).astype(np.int64)


ENDS_OF = [f"end{s}" for s in range(4)]
MATRIX = [f"m{s}{t}" for s in range(4) for t in range(4)]
EXITS = [f"to{s}" for s in range(4)]


def _matrices(table):
    """What each piece costs from one state before it to another behind it."""
    import numpy as np
    import pyarrow as pa

    b = Block(table)
    columns = {"conv": pa.array(b.convs), "block": pa.array([b.block] * len(b.convs), pa.int64())}
    for t in range(4):
        ends = np.full((len(b.convs), 4), FAR, dtype=np.int64)
        ends[:, t] = 0
        found = b.costs(ends)[b.starts]
        columns |= {f"m{s}{t}": pa.array(np.minimum(found[:, s], FAR)) for s in range(4)}
    return pa.table(columns).select(["conv", "block", *MATRIX])


def _ends(table):
    """What follows each piece of one conversation, from the last to the first."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("block")
    m = np.stack([table.column(c).to_numpy() for c in MATRIX], axis=1).reshape(-1, 4, 4)
    ends = np.empty((len(m), 4), dtype=np.int64)
    now = np.array(END, dtype=np.int64)
    for i in range(len(m) - 1, -1, -1):
        ends[i] = now
        now = (m[i] + now[None, :]).min(axis=1)
    last = [False] * (len(m) - 1) + [True]
    return pa.table({"conv": table.column("conv"), "block": table.column("block"), **{c: ends[:, s] for s, c in enumerate(ENDS_OF)}, "last": pa.array(last).cast(pa.int64())})


def _exits(table):
    """Where the least path of each piece leads from each state."""
    import numpy as np
    import pyarrow as pa

    b = Block(table)
    ends, last = b.given(table, ENDS_OF, END), b.given(table, ["last"], [1])[:, 0] == 1
    over = b.pointers(b.arcs(ends, last)[0])[-1]
    nodes = over[4 * b.starts[:, None] + np.arange(4)[None, :]]
    return pa.table({"conv": pa.array(b.convs), "block": pa.array([b.block] * len(b.convs), pa.int64()), **{c: nodes[:, s] % 4 for s, c in enumerate(EXITS)}})


def _entries(table):
    """The state that each piece of one conversation begins in, from the first to the last."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("block")
    to, now, out = np.stack([table.column(c).to_numpy() for c in EXITS], axis=1), NONE, []
    for row in to:
        out.append(now)
        now = int(row[now])
    return pa.table({"conv": table.column("conv"), "block": table.column("block"), "entry": pa.array(out, pa.int64())})


LINES = "array<struct<id:bigint,role:string>>"
AUDIT = f"conv string, block bigint, cost bigint, illegal bigint, first int, last int, audit string, lines {LINES}"


def _audits(table):
    """The edits of each piece, their cost, and the rows that remain (a null id: inserted; a null role: its own)."""
    import numpy as np
    import pyarrow as pa

    b = Block(table)
    ends, last = b.given(table, ENDS_OF, END), b.given(table, ["last"], [1])[:, 0] == 1
    piece, row, state, label = b.audit(b.given(table, ["entry"], [NONE])[:, 0], ends, last)
    price = np.array([0, *(COSTS[x] for x in (DELETE, INSERT, KEEP, REROLE))])[label]
    price = price + np.where((label == KEEP) | (label == REROLE), b.extra[row], 0)
    cost = np.bincount(piece, price, len(b.convs)).astype(np.int64)
    a, z = b.initial[:-1], b.initial[1:]
    legal = ((a == SYSTEM) & (z == USER)) | ((a == USER) & (z == ASSISTANT)) | ((a == ASSISTANT) & (z == USER))
    wrong = np.bincount(b.piece[1:][~legal & (b.piece[1:] == b.piece[:-1])], minlength=len(b.convs))
    audits, lines = [""] * len(b.convs), [[] for _ in b.convs]
    cuts = np.searchsorted(piece, np.arange(len(b.convs) + 1))
    names, letters = {USER: "user", ASSISTANT: "assistant"}, np.array(list(LETTERS))[label]
    for p in range(len(b.convs)):
        at = range(cuts[p], cuts[p + 1])
        audits[p] = "".join(letters[cuts[p] : cuts[p + 1]])
        lines[p] = [{"id": None if label[i] == INSERT else int(b.ids[row[i]]), "role": None if label[i] == KEEP else names[int(state[i])]} for i in at if label[i] != DELETE]
    of = pa.list_(pa.struct([("id", pa.int64()), ("role", pa.string())]))
    return pa.table(
        {
            "conv": pa.array(b.convs), "block": pa.array([b.block] * len(b.convs), pa.int64()), "cost": pa.array(cost), "illegal": pa.array(wrong.astype(np.int64)),
            "first": pa.array(b.initial[b.starts].astype(np.int32)), "last": pa.array(b.initial[b.stops - 1].astype(np.int32)), "audit": pa.array(audits), "lines": pa.array(lines, of),
        }
    )


def _pieces(ordered: DataFrame) -> DataFrame:
    """A row for each block of each conversation: see ``AUDIT``."""
    several = ordered.groupBy("conv").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b").select("conv")
    long = saved(ordered.join(several, "conv", "left_semi"), "long-conversations")
    longs = lambda names: "conv string, block bigint, " + ", ".join(f"{c} bigint" for c in names)
    matrices = long.groupBy("block").applyInArrow(_matrices, longs(MATRIX))
    ends = saved(matrices.groupBy("conv").applyInArrow(_ends, longs([*ENDS_OF, "last"])), "ends")
    exits = long.join(ends, ["conv", "block"]).groupBy("block").applyInArrow(_exits, longs(EXITS))
    entries = saved(exits.groupBy("conv").applyInArrow(_entries, longs(["entry"])), "entries")
    known = ordered.join(ends.join(entries, ["conv", "block"]), ["conv", "block"], "left")
    return saved(known.groupBy("block").applyInArrow(_audits, AUDIT), "audits")


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, rows): what was found and done in each conversation, and the repaired rows.

    audits: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``, where ``conv`` is ``conv_key``
    of the id; rows: ``conv, block, pos, role, text``, in order of ``block, pos`` within a conversation.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        _id(conv).alias("conv"), F.monotonically_increasing_id().alias("id"), F.col(turn).cast("bigint").alias("turn"), shown(role).alias("role"), shown(text).alias("text")
    )
    rows = saved(rows, "turns")
    ordered = _ordered(rows)
    pieces = _pieces(ordered)
    by_turn = ordered.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == k).alias(f"f{k}") for k in (1, 2, 3)])
    counted = by_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(f"f{k}").alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
    )
    listed = F.sort_array(F.collect_list(F.struct("block", "first", "last", "illegal", "audit")))
    pair = lambda x, y: (x * 4 + y).isin(SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER)
    joints = F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda i: ~pair(F.get("p", i - 1)["last"], F.get("p", i)["first"]))
    summed = pieces.groupBy("conv").agg(F.sum("cost").alias("cost"), listed.alias("p")).select(
        "conv", "cost", F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"),
        (F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["illegal"]) + F.when(F.size("p") > 1, F.size(joints)).otherwise(0)).alias("illegal"),
    )
    audits = counted.join(summed, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    lines = pieces.select("conv", "block", F.posexplode("lines").alias("pos", "line")).select("conv", "block", "pos", "line.id", F.col("line.role").alias("new"))
    had = lines.where("id IS NOT NULL").join(rows.select("id", "role", "text"), "id").select("conv", "block", "pos", F.coalesce("new", "role").alias("role"), "text")
    made = lines.where("id IS NULL").select("conv", "block", "pos", F.col("new").alias("role"), F.lit("").alias("text"))
    return audits, had.unionByName(made)


def conv_key(conv: str = "conv_id") -> Column:
    """The id of a conversation as ``repaired`` returns it."""
    return _id(conv)


def digests(rows: DataFrame) -> DataFrame:
    """``conv, sha256`` of the lines ``role:text`` of each conversation of repaired rows, joined by newlines.

    A conversation is a stream through one task, which holds a batch of rows.
    """

    def hashed(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        now, sha = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if conv != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["conv", "sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["conv", "sha256"])

    return rows.repartition("conv").sortWithinPartitions("conv", "block", "pos").select("conv", "role", "text").mapInArrow(hashed, "conv string, sha256 string")
