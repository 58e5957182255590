"""Repair of a conversation's structure at least cost, once for each ending that conversations share.

Rows of a conversation, by turn (missing turns first, then by role and text), have a fault each at
most, the first that holds of: blank (nothing but ASCII white space), duplicate (role and text stood
earlier), truncated (the last character other than white space is none of ``.!?``). The repaired roles,
by their initials, must read ``(s?(ua)+)?``. Edits and costs: Keep 0, Rerole to user or assistant 2,
Delete 3 (the only edit of a blank or duplicate row), Insert an empty user or assistant row 2; a
truncated row that stays adds 1. Among the cheapest repairs, the one whose edits' initials come first.

What a repair costs depends on the *signature* alone: a symbol for each row, of its role and fault. The
distinct signatures, read from their ends, are an automaton whose nodes are the endings that signatures
share. For each node and state of the grammar, the cost to go and the first edit of the best repair of
that ending are computed from the node behind it. Signatures are sorted by their reversed text in range
partitions, so the nodes of a signature lie on a stack, and what it shares with the one before it stays
there; only the path at the edge of two partitions is computed in both. A node whose costs differ by a
constant from a known one's behind the same symbol takes over its edits. Signatures are joined back to
their conversations, and the edits are applied by array functions.

Edits of one node and state have different initials (Rerole and Insert have one legal role), so the
first edit settles a tie, and best endings are chains of first edits that nodes share.

Defined results: a missing role or text is one space; rows without conversation id are one conversation
without id; repeated rows are duplicates; a conversation whose rows are all absent has zeros and an
empty repair; turns too far apart for a long give missing ``gaps``; no rows give no rows; other columns
do not take part. A conversation's rows meet in one task, as its repaired text does.
"""

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swayline.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant. Legal roles and the state that each leads to.
LEGAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a rerole or an insert gives in a state.
WANTED = ("u", "u", "a", "u")
FINAL = (True, False, False, True)
FAR = 1 << 60
#: Symbols of a signature that the range partitions look at, from its end.
ENDING = 64


def relaxed(options):
    """(costs, first edits) of the states, from their options (cost, edit) that use up a row; inserts come on top."""
    cost = [min((o[0] for o in own), default=FAR) for own in options]
    for _ in LEGAL:
        cost = [min(c, INSERT + cost[LEGAL[q][WANTED[q]]]) for q, c in enumerate(cost)]
    edits = []
    for q, own in enumerate(options):
        inserted = INSERT + cost[LEGAL[q][WANTED[q]]]
        edits.append(min([o[1] for o in own if o[0] == cost[q]] + ["I"] * (inserted == cost[q]), default=""))
    return tuple(cost), tuple(edits)


#: The node of the empty ending; "" ends a repair.
END = relaxed([[(0, "")] if final else [] for final in FINAL])


def before(symbol, cost):
    """The node of an ending with ``symbol`` in front of one with the costs ``cost``."""
    options = []
    for q in range(len(LEGAL)):
        own = [(DELETE + cost[q], "D")]
        if symbol != "x":
            extra, role = TRUNCATED * symbol.isupper(), symbol.lower()
            if role in LEGAL[q]:
                own.append((KEEP + extra + cost[LEGAL[q][role]], "K"))
            own.append((REROLE + extra + cost[LEGAL[q][WANTED[q]]], "R"))
        options.append(own)
    return relaxed(options)


class Endings:
    """Nodes of the endings of the signature at hand, the empty one first; equal ones are computed once."""

    def __init__(self):
        self.path, self.nodes, self.known, self.made = "", [END], {}, 0

    def turn_to(self, reversed_signature):
        shared = 0
        for a, b in zip(self.path, reversed_signature):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in reversed_signature[shared:]:
            cost, _ = self.nodes[-1]
            least = min(cost)
            key = symbol, tuple(c - least for c in cost)
            if key not in self.known:
                self.known[key] = before(*key)
            costs, edits = self.known[key]
            self.nodes.append((tuple(c + least for c in costs), edits))
            self.made += 1
        self.path = reversed_signature

    def repair(self):
        """(cost, edits' initials, role given by each edit, row of each edit or -1) from the beginning of the grammar."""
        state, row, edits, roles, rows = 0, 0, [], [], []
        left = len(self.path)
        while edit := self.nodes[left][1][state]:
            role = WANTED[state] if edit in "RI" else self.path[left - 1].lower()
            edits.append(edit)
            roles.append(role if edit in "RI" else " ")
            rows.append(-1 if edit == "I" else row)
            state = state if edit == "D" else LEGAL[state][role]
            if edit != "I":
                left, row = left - 1, row + 1
        return self.nodes[-1][0][0], "".join(edits), "".join(roles), rows


SOLVED = "signature string, cost long, audit string, given string, source array<int>"


def solve(signatures):
    """(signature, cost, audit, given, source) of the distinct ``signature`` values."""

    def scan(batches):
        endings = Endings()
        for batch in batches:
            out = []
            for signature in batch.column(0).to_pylist():
                endings.turn_to(signature[::-1])
                out.append((signature, *endings.repair()))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["signature", "cost", "audit", "given", "source"])

    ordered = signatures.select("signature", F.reverse("signature").alias("back"))
    ordered = ordered.repartitionByRange(F.substring("back", 1, ENDING)).sortWithinPartitions("back")
    return ordered.select("signature").mapInArrow(scan, SOLVED)


def faulty(turns):
    """One row per conversation: counts of faults, ``signature``, ``turns`` (role, text by order); see ``repair``."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "present",
    )
    order = W.partitionBy("conv_id").orderBy(F.desc("present"), F.col("turn").asc_nulls_first(), "role", "text")
    seen = W.partitionBy("conv_id", "present", "role", "text").orderBy("number")
    bare, initial = F.rtrim("text", F.lit(WHITE)), F.substring("role", 1, 1)
    rows = rows.withColumn("number", F.row_number().over(order)).withColumn("last", F.lag(initial).over(order))
    rows = rows.withColumn("repeat", F.row_number().over(seen) > 1)
    fault = F.when(bare == "", "blank").when(F.col("repeat"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", F.coalesce(fault, F.lit("")))
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    illegal = F.col("last").isNotNull() & ~F.concat("last", initial).isin("su", "ua", "au")
    each = F.struct("number", "turn", "role", "text", symbol.alias("symbol"))

    def count(condition):
        return F.sum((F.col("present") & condition).cast("long"))

    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("present"), each))).alias("turns"),
        F.min(F.when(F.col("present"), F.col("turn"))).cast("decimal(38,0)").alias("first"),
        F.max(F.when(F.col("present"), F.col("turn"))).cast("decimal(38,0)").alias("final"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], count(illegal).alias("illegal"),
    )
    distinct = F.size(F.array_distinct(F.filter(F.col("turns.turn"), lambda t: t.isNotNull())))
    gaps = F.when(F.col("first").isNull(), F.lit(0).cast("long")).otherwise((F.col("final") - F.col("first") + 1 - distinct).try_cast("long"))
    return grouped.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.concat_ws("", "turns.symbol").alias("signature"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )


def repair(turns):
    """One row per conversation: conv_id, counts of faults, cost, audit (edits' initials), repaired (array of role, text).

    ``turns`` has conv_id, turn, role, text and, optionally, ``present``: rows that are not only name their conversation.
    """
    if "present" not in turns.columns:
        turns = turns.withColumn("present", F.lit(True))
    found = written(faulty(turns), "conversations")
    solved = solve(found.select("signature").distinct()).withColumnRenamed("signature", "s_signature")
    joined = found.join(solved, F.col("signature") == F.col("s_signature"))

    def edited(e):
        own = F.get("turns", e["source"])
        role = F.when(e["given"] == "u", ROLES["u"]).when(e["given"] == "a", ROLES["a"]).otherwise(own["role"])
        return F.struct(role.alias("role"), F.when(e["edit"] == "I", "").otherwise(own["text"]).alias("text"))

    edits = F.arrays_zip(F.split("audit", "").alias("edit"), F.split("given", "").alias("given"), F.col("source").alias("source"))
    kept = F.filter(edits, lambda e: (e["edit"] != "D") & (e["edit"] != ""))
    return joined.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.transform(kept, edited).alias("repaired"),
    )


def damaged(conversations):
    """Turns with one of five damages each, or none, by crc32 of ``conv_id:turn``; dropped ones are not ``present``."""
    def name(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, ROLES["u"]).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"))


def op13_conversation_repair(spark, sf_dir):
    out = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return out.select(*[c for c in out.columns if c != "repaired"], F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t)"""


def _least(*options):
    return f"list_min([{', '.join(options)}])"


def _option(cost, initial, line, then):
    """SQL of an edit in front of the best repair ``then`` (struct of cost c, audit a, lines r)."""
    lines = f"{then}.r" if line is None else f"list_prepend({line}, {then}.r)"
    return f"{{'c': {cost} + {then}.c, 'a': '{initial}' || {then}.a, 'r': {lines}}}"


def _sql():
    far = f"{{'c': {1 << 40}, 'a': '', 'r': []::VARCHAR[]}}"

    def consumed(q):
        """Best repair from state ``q`` that uses up the row at hand first."""
        role, line, made = "substr(role, 1, 1)", "role || ':' || text", f"'{ROLES[WANTED[q]]}:' || text"
        keep = " ".join(f"WHEN {role} = '{r}' THEN {_option('cut', 'K', line, f'v{to}')}" for r, to in LEGAL[q].items())
        options = [_option(3, "D", None, f"v{q}"), f"CASE WHEN gone THEN {far} {keep} ELSE {far} END",
                   f"CASE WHEN gone THEN {far} ELSE {_option('2 + cut', 'R', made, f'v{LEGAL[q][WANTED[q]]}')} END"]
        return _least(*options)

    def opened(q, depth=2):
        """Best repair from state ``q``, with up to ``depth`` rows inserted before the next is used up."""
        options, state, lines = [f"c{q}"], q, []
        for n in range(1, depth + 1):
            lines.append(f"'{ROLES[WANTED[state]]}:'")
            state = LEGAL[state][WANTED[state]]
            options.append(f"{{'c': {2 * n} + c{state}.c, 'a': '{'I' * n}' || c{state}.a, 'r': list_concat([{', '.join(lines)}], c{state}.r)}}")
        return _least(*options)

    done = "{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
    ends = ", ".join(f"{done if final else far} AS c{q}" for q, final in enumerate(FINAL))
    start = ", ".join(f"{opened(q)} AS v{q}" for q in range(4))
    return f"""
WITH RECURSIVE {_CRC},
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 0 THEN [] WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS number FROM damaged),
marked AS (
  SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY number) > 1 AS again,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY number) || substr(role, 1, 1) AS step FROM numbered),
told AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN substr(bare, length(bare), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM marked),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal, max(number) AS n
  FROM told GROUP BY conv_id),
steps AS (
  SELECT conv_id, n AS spot, {start} FROM (SELECT *, {ends} FROM sums)
  UNION ALL
  SELECT conv_id, spot, {start} FROM (
    SELECT conv_id, spot - 1 AS spot, {', '.join(f"{consumed(q)} AS c{q}" for q in range(4))}
    FROM (SELECT s.*, role, text, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut
          FROM steps s JOIN told t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.number = s.spot))),
best AS (SELECT conv_id, v0.c AS cost, v0.a AS audit, sha256(array_to_string(v0.r, chr(10))) AS hash FROM steps WHERE spot = 0)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()
