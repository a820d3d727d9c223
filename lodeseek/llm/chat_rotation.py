"""Chat formatting by perspective rotation: DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant
and the others as named users; the mask holds the character ranges (code points, end exclusive) of the
assistant's turns, on which alone a model is trained.  System turns stay system turns and are nobody.

A rendering is one row, ``part`` 0, up to ``part_turns`` turns.  A longer one is written as numbered
parts of that many turns, so that no row grows without bound: ``start`` is the part's place in the
whole rendering, mask ranges count from the whole's beginning, the parts one after another are the
whole, and every participant of the dialogue has every part, silent there or not.  The turns of such a
dialogue are put in order by ranges over many tasks; lengths of parts, not texts, are summed by
dialogue.

Defined results: turns of one number are ordered by role, then text; a null turn counts as 0; a null
role is a participant without a name (null), apart from one who is called "unknown"; a null text is
empty; a row without a conv_id belongs to no dialogue and is one of its own; markers within texts and
roles are broken up and a line break in a role is a blank; a dialogue of system turns alone has no
rows; repeated rows are turns of their own; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .array_sql import scan
from .storage import written

#: Turns of one row of the result.
PART_TURNS = 1024
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT_HEAD, SYSTEM_HEAD = f"{OPEN}assistant\n", f"{OPEN}{SYSTEM}\n"
NAMED = " name="


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, who (\"\" without a role, else \"=\" and the role), head for those who are not the
    assistant, text."""
    broken = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.col("role").cast("string")
    name = F.concat(F.lit(f"{OPEN}user{NAMED}"), F.translate(broken(role), "\r\n", "  "), F.lit("\n"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.concat(F.lit("="), role), F.lit("")).alias("who"),
        F.when(role == SYSTEM, SYSTEM_HEAD).when(role.isNull(), f"{OPEN}user\n").otherwise(name).alias("head"),
        broken(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )


def _placed(long: DataFrame) -> DataFrame:
    """The turns of long dialogues with ``at``, their number within the dialogue in order."""
    order = ["conv_id", "turn", "who", "text", "tie"]
    # ranges of the whole order: no task has to sort a dialogue
    ranged = long.withColumn("tie", F.monotonically_increasing_id())
    ranged = written(written(ranged, "long-turns").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    own = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order[1:])) - 1
    return ranged.withColumn("own", own).join(sizes, ["conv_id", "range"]).withColumn("at", F.col("own") + F.col("earlier")).drop("own", "earlier", "range", "tie")


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, participant, part, start, n_turns, n_trained, rendered, mask (array of start, end)."""
    turns = _turns(conversations)
    known = turns.where("conv_id IS NOT NULL")
    many = known.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > part_turns).select("conv_id")
    many = written(many, "long-dialogues")
    none = many.isEmpty()
    turn = F.struct("turn", "who", "text", "head")
    short = known if none else known.join(many, "conv_id", "left_anti")
    parts = short.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("conv_id", F.lit(0).cast("long").alias("part"), "turns")
    single = _rendered(turns.where("conv_id IS NULL").select("conv_id", F.lit(0).cast("long").alias("part"), F.array(turn).alias("turns")).withColumn("participants", _participants()))
    out = single.unionByName(_rendered(parts.withColumn("participants", _participants())))
    if not none:
        out = out.unionByName(_long(_placed(known.join(many, "conv_id")), part_turns))
    return out


def _participants():
    return F.expr(f"array_distinct(filter(transform(turns, t -> t.who), w -> w <> '={SYSTEM}'))")


def _rendered(parts: DataFrame) -> DataFrame:
    """One row a participant of each part that is a whole dialogue."""
    return _texts(parts.withColumn("who", F.explode("participants")).withColumn("start", F.lit(0).cast("long")))


def _long(placed: DataFrame, part_turns: int) -> DataFrame:
    """One row a participant and part of long dialogues."""
    in_part = F.floor(F.col("at") / part_turns).cast("long").alias("part")
    parts = placed.groupBy("conv_id", in_part).agg(F.array_sort(F.collect_list(F.struct("at", "turn", "who", "text", "head"))).alias("turns"))
    # what a part is long for its participants: all turns as others', and the difference of own ones
    slim = placed.select("conv_id", in_part, "who", (F.length("head") + F.length("text") + len(CLOSE)).alias("long"), (F.lit(len(ASSISTANT_HEAD)) - F.length("head")).alias("less"))
    slim = written(slim.groupBy("conv_id", "part", "who").agg(F.sum("long").alias("long"), F.sum("less").alias("less")), "part-lengths")
    whole = slim.groupBy("conv_id", "part").agg(F.sum("long").alias("long"))
    people = slim.where(F.col("who") != f"={SYSTEM}").select("conv_id", "who").distinct()
    lengths = people.join(whole, "conv_id").join(slim.select("conv_id", "part", "who", "less"), ["conv_id", "part", "who"], "left")
    before = Window.partitionBy("conv_id", "who").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("conv_id", "part", "who", F.coalesce(F.sum(F.col("long") + F.coalesce("less", F.lit(0))).over(before), F.lit(0)).alias("start"))
    return _texts(parts.join(starts, ["conv_id", "part"]))


def _texts(rows: DataFrame) -> DataFrame:
    """Renders rows of conv_id, part, turns, who and start."""
    head = ASSISTANT_HEAD.replace("\n", "\\n")
    d = rows.withColumn("pieces", F.expr(f"transform(turns, t -> named_struct('own', t.who = who, 'head', CASE WHEN t.who = who THEN '{head}' ELSE t.head END, 'text', t.text))"))
    d = d.withColumn("sizes", F.expr(f"transform(pieces, p -> named_struct('own', p.own, 'head', length(p.head), 'all', length(p.head) + length(p.text) + {len(CLOSE)}))"))
    spans = scan("sizes", "start", "a.s + x.all", "CASE WHEN x.own THEN named_struct('start', a.s + x.head, 'end', a.s + x.all - 1) END", "struct<start:bigint,end:bigint>")
    d = d.withColumn("mask", F.expr(f"filter({spans}, m -> m IS NOT NULL)"))
    close = CLOSE.replace("\n", "\\n")
    return d.select(
        "conv_id",
        F.expr("CASE WHEN who <> '' THEN substr(who, 2) END").alias("participant"),
        "part",
        "start",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("mask").cast("long").alias("n_trained"),
        F.expr(f"array_join(transform(pieces, p -> concat(p.head, p.text, '{close}')), '')").alias("rendered"),
        "mask",
    )


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return d.withColumn("mask", F.expr("array_join(transform(mask, m -> concat(m.start, ':', m.end)), ',')"))


#: Whole dialogues; the query's parts are those of dialogues beyond PART_TURNS turns, which the tables
#: do not have.
SQL = f"""
WITH t AS (
  SELECT CASE WHEN conv_id IS NULL THEN -row_number() OVER () END AS alone, conv_id, coalesce(turn, 0) AS turn, role,
         replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY alone, conv_id ORDER BY turn, role NULLS FIRST, text) AS k FROM t
), p AS (
  SELECT DISTINCT alone, conv_id, role AS participant FROM t WHERE role IS DISTINCT FROM '{SYSTEM}'
), r AS (
  SELECT p.*, k, role IS NOT DISTINCT FROM participant AS own, text,
         CASE WHEN role = '{SYSTEM}' THEN '{OPEN}{SYSTEM}' WHEN role IS NOT DISTINCT FROM participant THEN '{OPEN}assistant'
              WHEN role IS NULL THEN '{OPEN}user' ELSE '{OPEN}user{NAMED}' || replace(replace(replace(role, '<|', '< |'), chr(10), ' '), chr(13), ' ') END || chr(10) AS head
  FROM p JOIN n ON p.alone IS NOT DISTINCT FROM n.alone AND p.conv_id IS NOT DISTINCT FROM n.conv_id
), s AS (
  SELECT *, head || text || '{CLOSE[:-1]}' || chr(10) AS piece FROM r
), a AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY alone, conv_id, participant ORDER BY k) - length(piece) AS begun FROM s
)
SELECT conv_id, participant, 0::BIGINT AS part, 0::BIGINT AS start, count(*)::BIGINT AS n_turns, sum(own::INT)::BIGINT AS n_trained,
       string_agg(piece, '' ORDER BY k) AS rendered,
       coalesce(string_agg((begun + length(head))::BIGINT || ':' || (begun + length(piece) - 1)::BIGINT, ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM a GROUP BY alone, conv_id, participant
"""
