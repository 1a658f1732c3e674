"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

The template is data: markers, the roles that carry loss and the allowed order of roles. The machine's state is the role of the
previous turn, so validating a turn needs one row of look-back; Spark sorts each conversation and the turns stream through a window,
so a conversation of any length needs no more memory than the sort, which spills.

Defined results: a null text is empty; a null role is the empty role, which no transition allows; a null turn sorts first; rows that
share a turn are ordered by role, then text, repeated rows stay; a null conversation id is a conversation of its own; an empty table
gives an empty table; other columns are ignored.
"""
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers around a turn, the escape sign, roles under the loss mask and, per state, the roles that may follow."""
    open_mark: str = "<turn "
    open_end: str = ">\n"
    close_mark: str = "</turn>"
    close_end: str = "\n"
    escape: str = "\\"
    loss_roles: tuple = ("assistant",)
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final_roles: tuple = ("assistant",)

    def control_strings(self):
        return self.open_mark, self.close_mark


def escaped(text: Column, template: Template) -> Column:
    """The text with no control string in it: the escape sign is doubled and put after the first character of control strings."""
    out = F.replace(text, F.lit(template.escape), F.lit(template.escape * 2))
    for control in template.control_strings():
        out = F.replace(out, F.lit(control), F.lit(control[0] + template.escape + control[1:]))
    return out


def unescaped(text: Column, template: Template) -> Column:
    """Inverse of ``escaped``: every escape sign stands for the character after it."""
    sign = "".join("\\" + c for c in template.escape)
    return F.regexp_replace(text, F.lit(f"(?s){sign}(.)"), F.lit("$1"))


def format_conversations(df: DataFrame, template: Template = Template(), conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Segments in order: (conv_id, turn_no, segment 0-2, kind open/text/close, content, loss, valid).

    The concatenation of ``content`` by (turn_no, segment) is the formatted conversation. ``valid`` tells whether the machine allows
    the turn's role after the one before; ``invalid_conversations`` lists what it refuses.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    machine = F.create_map(*[part for state, nexts in template.follows.items() for part in (F.lit(state), F.array(*map(F.lit, nexts)))])
    rows = rows.select("conv_id", "role", "text", F.row_number().over(order).alias("turn_no"), F.lag("role", 1, "").over(order).alias("state"))
    valid = F.coalesce(F.array_contains(F.element_at(machine, F.col("state")), F.col("role")), F.lit(False))
    loss = F.col("role").isin(*template.loss_roles)
    name = F.replace(escaped(F.col("role"), template), F.lit(">"), F.lit(template.escape + ">"))

    def part(no, kind, content, flag):
        return F.struct(F.lit(no).alias("segment"), F.lit(kind).alias("kind"), content.alias("content"), flag.alias("loss"))

    parts = F.array(part(0, "open", F.concat(F.lit(template.open_mark), name, F.lit(template.open_end)), F.lit(False)),
                    part(1, "text", escaped(F.col("text"), template), loss),
                    part(2, "close", F.lit(template.close_mark + template.close_end), F.lit(False)))
    return rows.select("conv_id", "turn_no", valid.alias("valid"), F.inline(parts))


def invalid_conversations(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Conversations with a turn that the machine refuses, or that end in a role that may not be the last."""
    opened = segments.filter(F.col("kind") == "open").groupBy("conv_id").agg(F.min("valid").alias("order_valid"), F.max_by("content", "turn_no").alias("last"))
    finals = [template.open_mark + role + template.open_end for role in template.final_roles]
    return opened.filter(~F.col("order_valid") | ~F.col("last").isin(*finals)).select("conv_id")


def assemble(segments: DataFrame) -> DataFrame:
    """One row per conversation: the formatted string and the half-open code-point ranges under the loss mask.

    A conversation becomes one value here, so its size is that of the training example it is.
    """
    in_order = Window.partitionBy("conv_id").orderBy("turn_no", "segment")
    end = F.sum(F.length("content")).over(in_order)
    placed = segments.select("conv_id", "turn_no", "segment", "content", "loss", end.alias("end"), (end - F.length("content")).alias("start"))
    return (placed.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn_no", "segment", "content"))).alias("parts"),
                 F.array_sort(F.collect_list(F.when(F.col("loss"), F.struct("start", "end")))).alias("loss_spans"))
            .select("conv_id", F.concat_ws("", F.transform("parts", lambda p: p["content"])).alias("formatted"), "loss_spans"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns read from formatted conversations: arrays of role and text. Control strings never occur inside texts, so a split finds them."""
    pieces = F.split(F.col("formatted"), F.lit("\\Q" + template.close_mark + template.close_end + "\\E"), -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    head, tail = len(template.open_mark), "\\Q" + template.open_end + "\\E"
    sign = "".join("\\" + c for c in template.escape)

    def turn(piece):
        body = F.substring(piece, F.lit(head + 1), F.length(piece))
        name = F.regexp_extract(body, f"(?s)^([^>{sign}]*+(?:{sign}.[^>{sign}]*+)*+){tail}", 1)
        return F.struct(unescaped(name, template).alias("role"), unescaped(F.substring(body, F.length(name) + F.lit(len(template.open_end) + 1), F.length(body)), template).alias("text"))

    return formatted.select("*", F.transform(turns, turn).alias("turns"))
