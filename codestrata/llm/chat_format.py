"""Chat formatting as event-sourced reconstruction, in DataFrame operations only.

Input: a log of events (conv_id, seq, event, msg_id, role, text). Events of a conversation
are put in order of seq and folded into final messages:

* ``message`` opens a message and sets its text; ``delta`` appends to it;
* ``edit`` replaces what the message held so far;
* ``regenerate`` empties the message, and messages opened between it and the regeneration
  are superseded (they answered the discarded text).

Messages are then rendered by a template whose control strings are escaped reversibly
inside texts, with the spans of the trained-on (assistant) texts.

One exchange, on conv_id: all windows and the final aggregate share that partitioning. A
conversation is one output row by contract, so its messages meet in one task; partial
sums are windows over (conversation, order), which spill.

Edge cases: null text is empty; null role is the empty role; null seq sorts first; ties on
seq are ordered by role, then text; repeated events count as often as they occur; a
null conv_id is a conversation of its own; an empty log gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn: open + role + \\n + text + close. Every mark starts with < or [ and holds neither again, nor an ampersand."""

    open: str = "<s>[INST] "
    close: str = " [/INST]</s>\n"
    controls: tuple[str, ...] = field(default=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    trained_role: str = "assistant"

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("&"), F.lit("&amp;"))
        for k, s in enumerate(self.controls):
            out = F.replace(out, F.lit(s), F.lit(f"&#{k};"))
        return out

    def unescape(self, text: Column) -> Column:
        for k, s in enumerate(self.controls):
            text = F.replace(text, F.lit(f"&#{k};"), F.lit(s))
        return F.replace(text, F.lit("&amp;"), F.lit("&"))

    def escape_sql(self, text: str) -> str:
        out = f"replace({text}, '&', '&amp;')"
        for k, s in enumerate(self.controls):
            out = f"replace({out}, '{s}', '&#{k};')"
        return out


#: Roles are escaped too, and their line breaks, as a break ends the role.
BREAK = ("\n", "&nl;")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, pos (order of opening), role, text."""
    by_conv = Window.partitionBy("conv_id")
    by_msg = Window.partitionBy("conv_id", "msg_id")
    e = events.select(
        "conv_id",
        "seq",
        "event",
        "msg_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    e = e.withColumn("at", F.row_number().over(by_conv.orderBy(F.col("seq").asc_nulls_first(), "msg_id", "role", "text")))
    e = e.withColumn("opened", F.min("at").over(by_msg))
    e = e.withColumn("reset", F.max(F.when(F.col("event").isin("message", "edit", "regenerate"), F.col("at"))).over(by_msg))
    # only the opening event names the role
    e = e.withColumn("role", F.max(F.when(F.col("at") == F.col("opened"), F.col("role"))).over(by_msg))
    redo = F.when(F.col("event") == "regenerate", F.col("opened"))
    e = e.withColumn("later", F.min(redo).over(by_conv.orderBy("at").rowsBetween(1, Window.unboundedFollowing)))
    # a message is superseded if some later regeneration's own message was opened before it
    e = e.withColumn("gone", F.max(F.when(F.col("at") == F.col("opened"), F.coalesce(F.col("later") < F.col("opened"), F.lit(False)))).over(by_msg))
    kept = e.filter(~F.col("gone") & (F.col("at") >= F.coalesce("reset", "opened")))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return kept.groupBy("conv_id", "msg_id", "opened").agg(F.min_by("role", "at").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")).withColumnRenamed("opened", "pos")


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points): a row for each conversation."""
    role = F.replace(template.escape(F.col("role")), F.lit(BREAK[0]), F.lit(BREAK[1]))
    head = F.concat(F.lit(template.open), role, F.lit("\n"))
    body = template.escape(F.col("text"))
    turns = messages.select("conv_id", "pos", F.col("role").eqNullSafe(template.trained_role).alias("trained"), head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(template.close)))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("from", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "piece", "trained", "from", F.length("body").alias("size"))))
    out = turns.groupBy("conv_id").agg(rows.alias("t"))
    spans = F.transform(F.filter("t", lambda t: t["trained"]), lambda t: F.struct(t["from"].alias("start"), t["size"].cast("long").alias("length")))
    return out.select("conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    pieces = F.split(formatted, _quoted(template.open), -1)
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        p = F.substring(p, F.lit(1), F.length(p) - len(template.close))
        cut = F.instr(p, "\n")
        role = F.replace(F.substring(p, F.lit(1), cut - 1), F.lit(BREAK[1]), F.lit(BREAK[0]))
        return F.struct(template.unescape(role).alias("role"), template.unescape(F.substring(p, cut + 1, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in text)


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows of a table of finished turns as `message` events, each its own message."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)  # noqa: E731  null and empty are the same before ties are ordered
    c = conversations.select("conv_id", "turn", empty("role"), empty("text")).repartition("conv_id")
    return c.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("event"), F.row_number().over(order).cast("long").alias("msg_id"), "role", "text")


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What the contract asks for, read back from the formatted text and its mask."""
    turns = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform("loss_spans", lambda s: template.unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    out = formatted.withColumn("turns", read_back(F.col("formatted"), template)).withColumn("loss", F.array_join(masked, ""))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return digest(render(fold(as_events(rows.unionByName(probe)))))


_T = Template()
_ROLE = f"replace({_T.escape_sql('role')}, chr(10), '{BREAK[1]}')"
_PIECE = f"'{_T.open}' || {_ROLE} || chr(10) || {_T.escape_sql('text')} || '{_T.close[:-1]}' || chr(10)"
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, {_PIECE} AS piece FROM c),
a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn) AS turns,
         coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '') AS loss, sum(length(piece)) AS formatted_chars
  FROM o GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM a
"""
