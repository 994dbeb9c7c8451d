"""Conversation repair: the cheapest edits that make a conversation's roles ``system?, (user, assistant)*``.

Rows of a conversation stand in the order of turn (nulls first), role and text.  A row is blank (no character but ASCII
white space), else a duplicate (role and text stood earlier in the conversation), else truncated (its last character but
white space ends no sentence).  Blank rows and duplicates must be deleted; ``auction.py`` finds the edits.

Layout.  Equal rows (conversation, turn, role, text) are one line with a count first, so copies cost nothing later.  Lines
are dealt in ranges of that order, so a task holds conversations one after the other and repairs each that lies whole in
its range and has at most ``most_lines`` lines.  The rest, one or two conversations a range and long ones, is repaired in
chunks of ``chunk_lines`` lines: a task turns each chunk into a 4 x 4 matrix of distances, a conversation's matrices (a
few hundred bytes a chunk) give the prices at the chunks' ends, and with these each chunk is solved for itself.  So no
task holds a long conversation; only the edits of one conversation, a letter a row, meet in its row of the report.

Defined results: a null role or text is one blank; a null turn is a turn of its own before all others; a null
conversation id is a conversation of its own; an unknown role is kept only by deleting it or changing the role; repeated
rows are duplicates; an empty table gives an empty table; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import auction
from ledgerloom.llm.common import SPACE_BYTES, WORD_RE, stored, width

#: ASCII white space as characters, and the ends of sentences (fixed values of the rules).
SPACE = SPACE_BYTES.decode()
STOPS = ".!?"
ROLES = {auction.SYSTEM: "system", auction.USER: "user", auction.ASSISTANT: "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LINE = ("turn", "role", "text")


def cleaned(convs: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with null roles and texts as one blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def damaged(convs: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, without ends of sentences, twice, or said by the user."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = cleaned(convs).withColumn("fault", F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    rows = rows.where("fault <> 0").withColumns({"text": text, "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))})
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.withColumn("copy", copies).select("conv_id", *LINE)


def lines(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n``, the initial of the role and the faults that a row has alone, in order over ranges."""
    own = rows.groupBy("conv_id", *LINE).agg(F.count("*").alias("n"))
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    own = own.withColumns({"head": F.substring("role", 1, 1), "blank": ~F.col("text").rlike(WORD_RE), "cut": ~F.lit(STOPS).contains(end)})
    # Rows of one place in the order are one line, so ranges of it never have to split equal rows.
    return own.repartitionByRange(width(rows), "conv_id", *LINE).sortWithinPartitions("conv_id", *LINE)


HEADS = {"s": 1, "u": 2, "a": 3}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class Facts:
    """Counts over lines in order, which can be continued by those of the lines after them."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, head, n, blank, seen, cut):
        if blank:
            self.blank += n
        else:
            self.duplicate += n if seen else n - 1
            self.truncated += bool(cut and not seen)
        self.illegal += (n - 1 if (head, head) not in LEGAL else 0) + (self.last is not None and (self.last, head) not in LEGAL)
        self.first, self.last = head if self.first is None else self.first, head
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def follow(self, other: dict):
        """Counts of lines after these, as given by ``packed``."""
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, c, getattr(self, c) + other[c])
        self.illegal += self.last is not None and (self.last, other["first"]) not in LEGAL
        self.first, self.last = other["first"] if self.first is None else self.first, other["last"]
        if other["low"] is not None:
            self.turns -= other["low"] == self.high
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]

    def packed(self) -> dict:
        return dict(self.__dict__)

    def counts(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


FACTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"


def lattice_rows(head, n, blank, seen, cut, end: bool) -> tuple[auction.Rows, list[int]]:
    """Rows of a lattice from lines, and the line of each: copies beyond a row that may stay are a row that must go."""
    out: tuple[list, ...] = ([], [], [], [])
    line: list[int] = []

    def put(i, *values):
        line.append(i)
        for column, v in zip(out, values):
            column.append(v)

    for i, (h, k, b, s, c) in enumerate(zip(head, n, blank, seen, cut)):
        if b or s:
            put(i, 0, True, False, k)
        else:
            put(i, HEADS.get(h, 0), False, c, 1)
            if k > 1:
                put(i, 0, True, False, k - 1)
    return auction.rows_of(*out, end), line


#: A row is a line left for chunks (n), a conversation's report (audit) or a row of a repaired conversation (neither).
#: part and pos: the place in the order of all rows; item: the place in a repaired conversation.
SETTLED = "conv_id long, part long, pos long, item long, turn long, role string, text string, n long, head string, blank boolean, cut boolean, gaps long, blanks long, duplicate long, truncated long, illegal long, cost long, audit string"
NAMES = [c.split()[0] for c in SETTLED.split(", ")]


def batch_of(rows: list[dict], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in names], schema=schema)


SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in SETTLED.split(", ")])


def settle(ordered: DataFrame, most_lines: int, most_bytes: int = 4 << 20) -> DataFrame:
    """Repair what lies whole in a range; see SETTLED for the rows."""

    def repaired(conversations: list[list[dict]]):
        items, places = [], []
        for own in conversations:
            seen, facts, known = [], Facts(), set()
            for r in own:
                said = (r["role"], r["text"])
                seen.append(said in known)
                known.add(said)
                facts.add(r["turn"], r["head"], r["n"], r["blank"], seen[-1], r["cut"])
            rows, line = lattice_rows(*([r[c] for r in own] for c in ("head", "n", "blank")), seen, [r["cut"] for r in own], end=True)
            items.append(rows)
            places.append((own, line, facts))
        found = auction.solved(items, np.tile(auction.END, (len(items), 1)))
        for rows, (own, line, facts), by_state in zip(items, places, found):
            best = by_state[auction.START]
            letters, left = auction.spelled(rows, best.edits, auction.START)
            counts = facts.counts()
            counts["blanks"] = counts.pop("blank")
            yield {"conv_id": own[0]["conv_id"], "cost": best.cost, "audit": letters, **counts}
            for k, (at, state) in enumerate(left):
                r = own[line[at]] if at >= 0 else {"text": ""}
                yield {"conv_id": own[0]["conv_id"], "part": own[0]["part"], "pos": own[0]["pos"], "item": k, "role": ROLES[state] if state >= 0 else r["role"], "text": r["text"]}

    def run(batches):
        part, pos = TaskContext.get().partitionId(), 0
        first, whole, own, size = True, [], [], 0
        waiting = waiting_bytes = 0
        nothing = object()
        now = nothing
        rest: list[dict] = []
        rest_bytes = 0

        def leave(some):
            nonlocal rest_bytes
            rest.extend(some)
            rest_bytes += sum(len(r["text"]) for r in some)

        for batch in batches:
            for r in batch.to_pylist():
                if r["conv_id"] != now or now is nothing:
                    if first:
                        leave(own)
                        first = now is nothing
                    elif own:
                        whole.append(own)
                        waiting, waiting_bytes = waiting + len(own), waiting_bytes + size
                    now, own, size, long = r["conv_id"], [], 0, False
                r["part"], r["pos"] = part, pos
                pos += 1
                own.append(r)
                size += len(r["text"])
                if long or first or len(own) > most_lines or size > most_bytes:
                    long = True
                    leave(own)
                    own, size = [], 0
                if rest_bytes > most_bytes or len(rest) > 8192:
                    yield batch_of(rest, NAMES, SCHEMA)
                    rest.clear()
                    rest_bytes = 0
                if waiting > 8192 or waiting_bytes > most_bytes:
                    yield batch_of(list(repaired(whole)), NAMES, SCHEMA)
                    whole, waiting, waiting_bytes = [], 0, 0
        leave(own)  # the last conversation may go on in the next range
        if rest:
            yield batch_of(rest, NAMES, SCHEMA)
        if whole:
            yield batch_of(list(repaired(whole)), NAMES, SCHEMA)

    return ordered.mapInArrow(run, SETTLED)


CHUNK = f"conv_id long, part long, pos long, head binary, forced binary, cut binary, weight binary, line binary, matrix array<long>, {FACTS}"


def chunks(rest: DataFrame, chunk_lines: int) -> DataFrame:
    """Consecutive lines of a conversation as one row: the lattice's rows, their matrix and the counts.

    (part, pos) of a chunk is the place of its first line and names it.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    firsts = rest.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(F.struct("part", "pos")).alias("first"))
    told = rest.join(firsts, same("conv_id", "c") & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")))
    told = told.select("conv_id", "part", "pos", "turn", "head", "n", "blank", "cut", (F.struct("part", "pos") > F.col("first")).alias("seen"))
    told = told.withColumn("chunk", F.floor(F.col("pos") / chunk_lines))
    told = told.repartition(width(rest), "conv_id", "part", "chunk").sortWithinPartitions("conv_id", "part", "chunk", "pos")

    def packed(own: list[dict]) -> dict:
        facts = Facts()
        for r in own:
            facts.add(r["turn"], r["head"], r["n"], r["blank"], r["seen"], r["cut"])
        rows, line = lattice_rows(*([r[c] for r in own] for c in ("head", "n", "blank", "seen", "cut")), end=False)
        raw = {c: v.astype(k).tobytes() for c, v, k in (("head", rows.head, np.uint8), ("forced", rows.forced, np.uint8), ("cut", rows.truncated, np.uint8), ("weight", rows.weight, np.int64))}
        return {"conv_id": own[0]["conv_id"], "part": own[0]["part"], "pos": own[0]["pos"], **raw, "line": np.array(line, np.int32).tobytes(), "matrix": auction.rows_through(rows).ravel().tolist(), **facts.packed()}

    def run(batches):
        own: list[dict] = []
        key = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                now = (r["conv_id"], r["part"], r["chunk"])
                if now != key and own:
                    out.append(packed(own))
                    own = []
                key = now
                own.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, chunk_schema)
        if own:
            yield pa.RecordBatch.from_pylist([packed(own)], chunk_schema)

    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    chunk_schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CHUNK.split(", ")])
    return told.mapInArrow(run, CHUNK)


def binary_rows(r: dict) -> auction.Rows:
    """The lattice's rows of a chunk."""
    read = lambda c, k: np.frombuffer(r[c], k)
    return auction.rows_of(read("head", np.uint8).astype(np.int64), read("forced", np.uint8).astype(bool), read("cut", np.uint8).astype(bool), read("weight", np.int64), end=False)


#: The end of a conversation, where inserts are allowed once more.
TAIL = auction.rows_of([], [], [], [], end=True)


def prices(table: pa.Table) -> pa.Table:
    """For the chunks of a conversation: the distance to go from each state at each chunk's end."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["pos"]))
    chain = np.array([*(r["matrix"] for r in rows), auction.rows_through(TAIL).ravel()], np.int64).reshape(1, -1, 4, 4)
    after, _ = auction.ahead(chain, auction.END[None], (auction.START,))
    return pa.table({"part": [r["part"] for r in rows], "pos": [r["pos"] for r in rows], "ahead": after[0, : len(rows)].tolist()}, pa.schema([("part", pa.int64()), ("pos", pa.int64()), ("ahead", pa.list_(pa.int64()))]))


def solve_chunks(priced: DataFrame) -> DataFrame:
    """Edits and last state of each chunk for each first state, as arrays of four; null where a state leads nowhere."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                (found,) = auction.solved([binary_rows(r)], np.array([r["ahead"]], np.int64), tuple(range(4)))
                r["edits"] = [found[s].edits if s in found else None for s in range(4)]
                r["lasts"] = [found[s].last if s in found else None for s in range(4)]
                del r["ahead"]
            yield pa.RecordBatch.from_pylist(rows, schema)

    raw = {c: pa.binary() for c in ("head", "forced", "cut", "weight", "line")}
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("pos", pa.int64()), *raw.items(), ("edits", pa.list_(pa.binary())), ("lasts", pa.list_(pa.int64()))])
    names = ["conv_id", "part", "pos", *raw, "ahead"]
    return priced.select(*names).mapInArrow(run, f"conv_id long, part long, pos long, {', '.join(f'{c} binary' for c in raw)}, edits array<binary>, lasts array<long>")


def walk(table: pa.Table) -> pa.Table:
    """First states of a conversation's chunks in order, each the last state of the chunk before; then the end's own row.

    The end (no chunk, pos null) carries what closes the conversation and the counts of all chunks.
    """
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["pos"]))
    state, out, facts = auction.START, [], Facts()
    for r in rows:
        out.append({"conv_id": r["conv_id"], "part": r["part"], "pos": r["pos"], "state": state})
        state = r["lasts"][state]
        facts.follow(r)
    (tail,) = auction.solved([TAIL], auction.END[None], (state,))
    counts = facts.counts()
    counts["blanks"] = counts.pop("blank")
    out.append({"conv_id": rows[0]["conv_id"], "part": rows[-1]["part"], "state": state, "tail": tail[state].edits, **counts})
    return pa.Table.from_pylist(out, WALK_SCHEMA)


WALK_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("pos", pa.int64()), ("state", pa.int64()), ("tail", pa.binary()), *((c, pa.int64()) for c in ("gaps", "blanks", "duplicate", "truncated", "illegal"))])
WALK = "conv_id long, part long, pos long, state long, tail binary, gaps long, blanks long, duplicate long, truncated long, illegal long"


def spell_chunks(entered: DataFrame) -> DataFrame:
    """The letters and cost of each chunk and of each conversation's end, and what they leave: (line's place or null, role or null)."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = TAIL if r["pos"] is None else binary_rows(r)
                edits = r["tail"] if r["pos"] is None else r["edits"]
                letters, left = auction.spelled(rows, edits, r["state"])
                line = [] if r["pos"] is None else np.frombuffer(r["line"], np.int32).tolist()
                left = [{"at": r["pos"] + line[at] if at >= 0 else None, "role": ROLES[state] if state >= 0 else None} for at, state in left]
                out.append({"conv_id": r["conv_id"], "part": r["part"], "pos": r["pos"], "cost": cost_of(rows, edits), "letters": letters, "left": left})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("pos", pa.int64()), ("cost", pa.int64()), ("letters", pa.string()), ("left", pa.list_(pa.struct([("at", pa.int64()), ("role", pa.string())])))])
    return entered.mapInArrow(run, "conv_id long, part long, pos long, cost long, letters string, left array<struct<at: long, role: string>>")


def cost_of(rows: auction.Rows, edits: bytes) -> int:
    at = total = 0
    for e in edits:
        if e == auction.INSERT:
            total += auction.COST_INSERT
            continue
        total += int(auction.COST_DELETE * rows.weight[at]) if e == auction.DELETE else auction.COST_REROLE * (e == auction.REROLE) + auction.COST_TRUNCATED * int(rows.truncated[at])
        at += 1
    return total


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repair(rows: DataFrame, most_lines: int = 1024, chunk_lines: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation of ``rows`` (cleaned), and the rows of the repaired ones.

    The report has REPORT's columns; repaired rows are ``conv_id, part, pos, item, role, text`` in the order of the three
    middle columns.
    """
    out = stored(settle(lines(rows), most_lines), "settled")
    rest = out.where("n is not null")
    made = stored(chunks(rest, chunk_lines), "chunks")
    ends = made.groupBy("conv_id").applyInArrow(prices, "part long, pos long, ahead array<long>").withColumnsRenamed({"part": "p", "pos": "q"})
    solved = stored(solve_chunks(made.join(ends, (F.col("part") == F.col("p")) & (F.col("pos") == F.col("q")))), "solved")
    facts = made.select(F.col("part").alias("p"), F.col("pos").alias("q"), *[c.split()[0] for c in FACTS.split(", ")])
    walked = stored(solved.select("conv_id", "part", "pos", "lasts").join(facts, (F.col("part") == F.col("p")) & (F.col("pos") == F.col("q"))).groupBy("conv_id").applyInArrow(walk, WALK), "walked")

    states = walked.where("pos is not null").select(F.col("part").alias("p"), F.col("pos").alias("q"), "state")
    entered = solved.join(states, (F.col("part") == F.col("p")) & (F.col("pos") == F.col("q")))
    entered = entered.select("conv_id", "part", "pos", "head", "forced", "cut", "weight", "line", F.element_at("edits", F.col("state").cast("int") + 1).alias("edits"), "state")
    spelled = stored(spell_chunks(entered.unionByName(walked.where("pos is null").select("conv_id", "part", "pos", "state", "tail"), allowMissingColumns=True)), "spelled")

    piece = F.struct("part", F.coalesce("pos", F.lit(1 << 62)).alias("pos"), "letters")
    audits = spelled.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.concat_ws("", F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["letters"])).alias("audit"))
    ends = walked.where("pos is null").select(F.col("conv_id").alias("c"), "gaps", "blanks", "duplicate", "truncated", "illegal")
    long = audits.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    report = out.where("audit is not null").select("conv_id", "gaps", "blanks", "duplicate", "truncated", "illegal", "cost", "audit").unionByName(long)

    items = spelled.select("conv_id", "part", F.coalesce("pos", F.lit(1 << 62)).alias("pos"), F.posexplode("left").alias("item", "one")).select("conv_id", "part", "pos", F.col("item").cast("long").alias("item"), "one.at", F.col("one.role").alias("new_role"))
    texts = rest.select(F.col("part").alias("p"), F.col("pos").alias("q"), F.col("role"), F.col("text"))
    kept = items.where("at is not null").join(texts, (F.col("part") == F.col("p")) & (F.col("at") == F.col("q"))).select("conv_id", "part", "pos", "item", F.coalesce("new_role", "role").alias("role"), "text")
    put = items.where("at is null").select("conv_id", "part", "pos", "item", F.col("new_role").alias("role"), F.lit("").alias("text"))
    fixed = out.where("item is not null").select("conv_id", "part", "pos", "item", "role", "text").unionByName(kept).unionByName(put)
    return report.withColumnRenamed("blanks", "blank").select(*REPORT), fixed


def digests(fixed: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of each repaired conversation's ``role:text`` lines.

    A digest needs its rows in order, so each conversation streams through one task; nothing but the running digest is kept.
    """
    one = F.concat("role", F.lit(":"), "text").alias("said")
    ordered = fixed.select("conv_id", "part", "pos", "item", one).repartition(width(fixed), "conv_id").sortWithinPartitions("conv_id", "part", "pos", "item")

    def run(batches):
        now, running = None, None
        for batch in batches:
            ids, out = batch.column("conv_id").to_pylist(), []
            for conv_id, said in zip(ids, batch.column("said")):
                if running is None or conv_id != now:
                    if running is not None:
                        out.append((now, running.hexdigest()))
                    now, running = conv_id, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(said.as_buffer())
            if out:
                yield batch_pairs(out)
        if running is not None:
            yield batch_pairs([(now, running.hexdigest())])

    def batch_pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def known(convs: DataFrame) -> DataFrame:
    return convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()


def repair_table(convs: DataFrame, most_lines: int = 1024, chunk_lines: int = 4096) -> DataFrame:
    """The report and digest of every conversation of ``convs`` after damage; without rows: zeros and the digest of nothing."""
    report, fixed = repair(damaged(convs), most_lines, chunk_lines)
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    out = known(convs).join(report.withColumnRenamed("conv_id", "c"), same("c"), "left").join(digests(fixed).withColumnRenamed("conv_id", "d"), same("d"), "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
