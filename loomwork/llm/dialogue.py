"""Conversation structure repair by dynamic programming over a prefix trie of signatures.

A row of a conversation is one character of its signature: its role's initial (``s``, ``u``, ``a``, else ``x``), in upper
case if its text is truncated, or ``d`` if it is blank or a duplicate and must go. The cheapest edits are found by a
layer of states per row: what has been given out so far is nothing, ``s``, or ends in ``u`` or ``a``. A layer keeps for
each state the least cost and the rank of the ASCII-least edits of that cost. All edits of a layer end in the edit of the
same row, so none is the beginning of another and ranks suffice to compare them.

Signatures are sorted over the whole table. What neighbours share is a path of the trie, so a task keeps the layers of the
current path, computes a layer once for all signatures with that prefix, and gives out an answer where a signature ends.

Long conversations are not one signature. Rows are spread by ranges of (conversation, turn, role, text), which cuts a
conversation of any size, and a signature covers at most ``ROWS`` neighbouring rows. One that does not begin its
conversation is answered for each state that it may begin in; a conversation's answers are then put together in order. The
digest of the repaired texts goes over all of a conversation by definition: they stream through one task in order, which
holds a batch, the hash and the conversation's edits, a byte a row. Identical rows are counted before anything is shuffled,
and the first turn of each repeated text is looked up by a join, so neither needs a task that holds a conversation.

Cases: null role and text are one space, which is no role and blank; a role that is empty or begins with another letter
must be changed or deleted; null turns come first; rows of one turn go by role, then by the MD5 of the text; identical
rows are duplicates but for one; a null conv_id is a conversation; a conversation without rows after the damage has zeros,
no edits and the hash of an empty text; an empty table gives an empty result; columns but the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import light, passing, table, written

#: Rows of a signature.
ROWS = 4096
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: What has been given out: nothing, the system's row, or rows that end in the user's or the assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: By state: the states that insertions lead to, and how many they take.
INSERTED = (((NOTHING, 0), (USER, 1), (ASSISTANT, 2)), ((SYSTEM, 0), (USER, 1), (ASSISTANT, 2)), ((USER, 0), (ASSISTANT, 1)), ((ASSISTANT, 0), (USER, 1)))
#: By state: the state after one more user's or assistant's row.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage, which a hash of conversation and turn decides."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("harm != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def key_of(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def turn_key() -> Column:
    """Orders turns with nulls first."""
    return F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, key, n, blank, cut, later``: distinct rows, how often each stands, and whether its role and text stand in an earlier turn."""
    text = F.col("text")
    narrow = rows.select("conv_id", "turn", "role", key_of(text).alias("key"), (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                         (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    narrow = narrow.groupBy("conv_id", "turn", "role", "key").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    narrow = written(narrow, "conv-rows")
    again = narrow.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("key").alias("_key"))
    again = again.agg(F.min(turn_key()).alias("_first"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    again = light(written(again, "conv-again"), F.octet_length("_role") + 64)
    same = narrow["conv_id"].eqNullSafe(again["_conv"]) & (narrow["role"] == again["_role"]) & (narrow["key"] == again["_key"])
    later = F.coalesce(turn_key() > F.col("_first"), F.lit(False))
    return narrow.join(again, same, "left").select(*narrow.columns, later.alias("later"))


def signatures(rows: DataFrame, conv: str, turn: str, partitions: int, most: int = ROWS) -> DataFrame:
    """Neighbouring rows of a conversation as one signature, with the place of the first and what the rows count up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        first = True
        out: list[dict] = []

        def begun(row: dict, skip: int, inner: bool) -> dict:
            return {k: row[k] for k in ("conv_id", "turn", "role", "key")} | {
                "skip": skip, "inner": inner, "sig": [], "initials": (row["role"][:1], ""), "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0,
                "low": None, "high": None, "turns": 0, "last": None}

        def closed(x: dict) -> None:
            out.append(x | {"sig": "".join(x["sig"]), "from": x["initials"][0], "to": x["initials"][1]})

        for batch in batches:
            for row in batch.to_pylist():
                initial = row["role"][:1]
                for copy in range(row["n"]):
                    if now is None or now["conv_id"] != row["conv_id"]:
                        if now is not None:
                            closed(now)
                            first = False
                        now = begun(row, copy, first)
                    elif len(now["sig"]) == most:
                        closed(now)
                        now = begun(row, copy, True)
                    elif now["initials"][1] + initial not in LEGAL:
                        now["illegal"] += 1
                    now["initials"] = (now["initials"][0], initial)
                    letter = initial if initial in ("s", "u", "a") else "x"
                    if row["blank"]:
                        now["blank"] += 1
                        letter = "d"
                    elif row["later"] or copy:
                        now["duplicate"] += 1
                        letter = "d"
                    elif row["cut"]:
                        now["truncated"] += 1
                        letter = letter.upper()
                    now["sig"].append(letter)
                    at = row["turn"]
                    if at is not None and at != now["last"]:
                        now |= {"low": at if now["low"] is None else now["low"], "high": at, "last": at, "turns": now["turns"] + 1}
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out.clear()
        if now is not None:
            closed(now)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    names = SIGNATURE.format(conv=conv, turn=turn)
    schema = arrow_schema(rows.sparkSession, names)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "key"]
    return rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(run, names)


SIGNATURE = ("conv_id {conv}, turn {turn}, role string, key string, skip long, inner boolean, sig string, `from` string, `to` string, illegal long, "
             "blank long, duplicate long, truncated long, low {turn}, high {turn}, turns long")
ANSWERS = "array<struct<begin:int,end:int,cost:long,edits:string>>"


def arrow_schema(spark: SparkSession, names: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(names))


Layer = tuple  # by state: (cost above the least, rank), or None


@lru_cache(maxsize=100_000)
def after(layer: Layer, letter: str) -> tuple[int, Layer, tuple]:
    """The least cost added by a row, the next layer, and by state where its best edits come from: (state, edits)."""
    best: dict[int, tuple] = {}

    def offer(end: int, cost: int, rank: int, begin: int, edits: str) -> None:
        new = (cost, rank, edits, begin)
        if end not in best or new < best[end]:
            best[end] = new

    for begin, held in enumerate(layer):
        if held is None:
            continue
        cost, rank = held
        for at, n in INSERTED[begin]:
            paid, edits = cost + n * INSERT, "I" * n
            offer(at, paid + DELETE, rank, begin, edits + "D")
            if letter == "d":
                continue
            cut = CUT if letter.isupper() else 0
            role = letter.lower()
            if role == "s" and at == NOTHING:
                offer(SYSTEM, paid + cut, rank, begin, edits + "K")
            elif role == "u" and at != USER:
                offer(USER, paid + cut, rank, begin, edits + "K")
            elif role == "a" and at == USER:
                offer(ASSISTANT, paid + cut, rank, begin, edits + "K")
            offer(NEXT[at], paid + cut + REROLE, rank, begin, edits + "R")
    least = min(x[0] for x in best.values())
    ranks = {end: i for i, end in enumerate(sorted(best, key=lambda e: best[e][1:3]))}
    return (least, tuple((best[s][0] - least, ranks[s]) if s in best else None for s in range(4)),
            tuple((best[s][3], best[s][2]) if s in best else None for s in range(4)))


def traced(path: list[tuple], layer: Layer, begin: int) -> list[tuple[int, int, int, str]]:
    """The answers at the end of a path that begins in a state: (begin, end, cost, edits) of each end that can be reached."""
    base = sum(step[0] for step in path)
    out = []
    for end, held in enumerate(layer):
        if held is None:
            continue
        at, parts = end, []
        for _, _, back in reversed(path):
            at, edits = back[at]
            parts.append(edits)
        out.append((begin, end, base + held[0], "".join(reversed(parts))))
    return out


class Trie:
    """The path of the current signature, with the layers of each of its prefixes by the state that they begin in."""

    def __init__(self) -> None:
        self.sig = ""
        self.paths: dict[int, list[tuple]] = {}
        self.layers = 0

    def answers(self, sig: str, begins: tuple[int, ...]) -> list[tuple[int, int, int, str]]:
        shared = 0
        for a, b in zip(self.sig, sig, strict=False):
            if a != b:
                break
            shared += 1
        out = []
        for begin in begins:
            path = self.paths.setdefault(begin, [])
            del path[shared:]
            layer = path[-1][1] if path else tuple((0, 0) if s == begin else None for s in range(4))
            for letter in sig[len(path):]:
                step = after(layer, letter)
                path.append(step)
                layer = step[1]
                self.layers += 1
            out += traced(path, layer, begin)
        for begin in self.paths.keys() - set(begins):
            del self.paths[begin][shared:]
        self.sig = sig
        return out


def answered(parts: DataFrame, partitions: int) -> DataFrame:
    """The signatures with ``answers``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out_type = parts.withColumn("answers", F.lit(None).cast(ANSWERS)).schema
    schema = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, known = Trie(), None, []
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                now = (row["sig"], row["inner"])
                if now != last:
                    found = trie.answers(row["sig"], tuple(range(4)) if row["inner"] else (NOTHING,))
                    last, known = now, [dict(zip(("begin", "end", "cost", "edits"), x, strict=True)) for x in found]
                row["answers"] = known
            yield pa.RecordBatch.from_pylist(rows, schema)

    order = ["sig", "inner", "conv_id", "turn", "role", "key", "skip"]
    return parts.repartitionByRange(partitions, *order).sortWithinPartitions("sig", "inner").mapInArrow(run, out_type)


def joined(held: dict[int, tuple], answers: list[dict]) -> dict[int, tuple]:
    """By state: (cost, rank, edits as a chain) after one more signature."""
    best: dict[int, tuple] = {}
    for x in answers:
        if x["begin"] in held:
            cost, rank, chain = held[x["begin"]]
            new = (cost + x["cost"], rank, x["edits"], chain)
            if x["end"] not in best or new[:3] < best[x["end"]][:3]:
                best[x["end"]] = new
    ranks = {e: i for i, e in enumerate(sorted(best, key=lambda e: best[e][1:3]))}
    return {e: (cost, ranks[e], (chain, edits)) for e, (cost, _, edits, chain) in best.items()}


def finished(held: dict[int, tuple]) -> tuple[int, str]:
    """The cheapest edits that end in nothing or an assistant's row, insertions at the end included."""
    ends = [(cost + n * INSERT, rank, "I" * n, chain) for state, (cost, rank, chain) in held.items() for at, n in INSERTED[state] if at in (NOTHING, ASSISTANT)]
    cost, _, tail, chain = min(ends, key=lambda x: x[:3])
    parts = [tail]
    while chain is not None:
        chain, edits = chain
        parts.append(edits)
    return cost, "".join(reversed(parts))


class Repair:
    """One conversation: its signatures in order, then its texts in order."""

    def __init__(self, conv: object) -> None:
        self.conv = conv
        self.held: dict[int, tuple] = {NOTHING: (0, 0, None)}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.to = self.low = self.high = self.last = None
        self.edits: str | None = None
        self.hash, self.begun = hashlib.sha256(), False
        self.at, self.state, self.cost = 0, NOTHING, 0

    def part(self, row: dict) -> None:
        self.held = joined(self.held, row["answers"])
        for k in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[k] += row[k]
        self.counts["illegal"] += self.to is not None and self.to + row["from"] not in LEGAL
        self.to = row["to"]
        if row["low"] is not None:
            self.counts["turns"] += row["turns"] - (row["low"] == self.high)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]

    def settle(self) -> None:
        if self.edits is None:
            self.cost, self.edits = finished(self.held)
            self.held = {}

    def put(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.begun else "").encode() + f"{role}:{text}".encode())
        self.begun = True

    def give(self, role: str | None = None, text: str = "") -> None:
        """A row for the next place; without a role, the one that is due there."""
        if role is None:
            self.state = NEXT[self.state]
            self.put("user" if self.state == USER else "assistant", text)
        else:
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            self.put(role, text)

    def insertions(self) -> None:
        while self.edits[self.at:self.at + 1] == "I":
            self.at += 1
            self.give()

    def text(self, role: str, text: str) -> None:
        self.settle()
        self.insertions()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.give(role, text)
        elif edit == "R":
            self.give(None, text)

    def result(self) -> dict:
        self.settle()
        self.insertions()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts.pop("turns")
        return {"conv_id": self.conv, "gaps": gaps, **{k: self.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")},
                "cost": self.cost, "audit": self.edits, "repaired_sha256": self.hash.hexdigest()}


RESULT = "conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def assembler(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.conv != row["conv_id"]:
                    if now is not None:
                        out.append(now.result())
                    now = Repair(row["conv_id"])
                if row["kind"] == 1:
                    now.part(row)
                elif row["kind"] == 2:
                    now.text(row["role"], row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], schema)

    return run


def repaired(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    """The report of each conversation: ``RESULT``."""
    spark = conversations.sparkSession
    types = dict(conversations.dtypes)
    conv, turn = types["conv_id"], types["turn"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = damaged(conversations)
    with passing(spark):
        parts = written(signatures(faults(rows), conv, turn, partitions, most), "conv-signatures")
        parts = written(answered(parts, partitions), "conv-answers")
        order = ["turn", "role", "key", "skip"]
        none = {c: F.lit(None).cast(t) for c, t in parts.dtypes if c not in ("conv_id", *order)}
        texts = rows.select("conv_id", "turn", "role", key_of(F.col("text")).alias("key"), F.lit(0).cast("long").alias("skip"), "text", F.lit(2).alias("kind"))
        every = conversations.select("conv_id").distinct().withColumn("kind", F.lit(0))
        both = parts.withColumns({"kind": F.lit(1), "text": F.lit(None).cast("string")}).unionByName(texts.withColumns(none)).unionByName(every, allowMissingColumns=True)
        both = both.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), *order[1:])
        names = RESULT.format(conv=conv)
        return written(both.mapInArrow(assembler(arrow_schema(spark, names)), names), "conv-report", keep=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    """A state is its cost in eight digits and its edits, so the least text is the best one."""
    legal = ", ".join(f"'{x}'" for x in LEGAL)
    offers: dict[int, list[str]] = {end: [] for end in range(4)}
    for begin in range(4):
        held = "ENUA"[begin]
        for at, n in INSERTED[begin]:
            def offer(end: int, cost: str, edit: str, when: str, held: str = held, n: int = n) -> None:
                paid = f"lpad(CAST(CAST(substr({held}, 1, 8) AS INT) + {n * INSERT} + {cost} AS VARCHAR), 8, '0') || substr({held}, 9) || '{'I' * n}{edit}'"
                offers[end].append(f"CASE WHEN {when} THEN {paid} END")

            cut = f"CASE WHEN y BETWEEN 'A' AND 'Z' THEN {CUT} ELSE 0 END"
            offer(at, str(DELETE), "D", "true")
            for role, end, ok in (("s", SYSTEM, at == NOTHING), ("u", USER, at != USER), ("a", ASSISTANT, at == USER)):
                if ok:
                    offer(end, cut, "K", f"lower(y) = '{role}'")
            offer(NEXT[at], f"{REROLE} + {cut}", "R", "y <> 'd'")
    step = ", ".join(f"least({', '.join(offers[s])}, NULL)" for s in range(4))
    ends = ", ".join(f"lpad(CAST(CAST(substr({'ENUA'[s]}, 1, 8) AS INT) + {n * INSERT} AS VARCHAR), 8, '0') || substr({'ENUA'[s]}, 9) || '{'I' * n}'"
                     for s in range(4) for at, n in INSERTED[s] if at in (NOTHING, ASSISTANT))
    return _SQL.replace("{legal}", legal).replace("{step}", step).replace("{ends}", ends)


#: CRC-32 goes byte by byte and, for each, bit by bit; 256 stands for a bit.
_SQL = r"""
WITH RECURSIVE
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
b AS (
  SELECT *, flatten(list_transform(string_split(name, ''), lambda x: [ascii(x), 256, 256, 256, 256, 256, 256, 256, 256])) AS bits FROM h),
c AS (
  SELECT *, xor(list_reduce(list_transform(bits, lambda x: CAST(x AS BIGINT)), lambda a, x: CASE WHEN x < 256 THEN xor(a, x)
           WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS harm
  FROM b),
d AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE harm <> 0),
f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS k,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d)),
g AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
         CASE WHEN blank OR k > 1 THEN 'd' WHEN cut THEN upper(letter) ELSE letter END AS y
  FROM (SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS letter FROM f)),
n AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND k > 1) AS duplicate, count(*) FILTER (NOT blank AND k = 1 AND cut) AS truncated,
         count(*) FILTER (i > 1 AND previous || initial NOT IN ({legal})) AS illegal,
         list(y ORDER BY i) AS ys, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts
  FROM g GROUP BY conv_id),
a AS (
  SELECT k.conv_id, n.* EXCLUDE (conv_id) FROM (SELECT DISTINCT conv_id FROM conversations) AS k LEFT JOIN n ON k.conv_id IS NOT DISTINCT FROM n.conv_id),
r AS (
  SELECT conv_id, coalesce(ys, []) AS ys, 0 AS i, '00000000' AS E, CAST(NULL AS VARCHAR) AS N, CAST(NULL AS VARCHAR) AS U, CAST(NULL AS VARCHAR) AS A FROM a
  UNION ALL
  SELECT conv_id, ys, i + 1, s[1], s[2], s[3], s[4]
  FROM (SELECT conv_id, ys, i, [{step}] AS s FROM (SELECT *, ys[i + 1] AS y FROM r WHERE i < len(ys)))),
e AS (SELECT conv_id, least({ends}) AS best FROM r WHERE i = len(ys)),
p AS (
  SELECT a.conv_id, substr(e.best, 9) AS audit, a.roles, a.texts, 1 AS z, 1 AS j, 'e' AS state, CAST([] AS VARCHAR[]) AS given
  FROM a JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
  UNION ALL
  SELECT conv_id, audit, roles, texts, z + 1, CASE WHEN edit = 'I' THEN j ELSE j + 1 END,
         CASE WHEN edit = 'D' THEN state WHEN edit = 'K' THEN substr(roles[j], 1, 1) WHEN state = 'u' THEN 'a' ELSE 'u' END,
         CASE WHEN edit = 'D' THEN given WHEN edit = 'K' THEN list_append(given, roles[j] || ':' || texts[j])
              ELSE list_append(given, CASE WHEN state = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'R' THEN texts[j] ELSE '' END) END
  FROM (SELECT *, substr(audit, z, 1) AS edit FROM p WHERE z <= length(audit)))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(substr(e.best, 1, 8) AS BIGINT) AS cost, p.audit, sha256(array_to_string(p.given, chr(10))) AS repaired_sha256
FROM a JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id JOIN p ON a.conv_id IS NOT DISTINCT FROM p.conv_id AND p.z = length(p.audit) + 1
"""
ORACLE = _oracle()
