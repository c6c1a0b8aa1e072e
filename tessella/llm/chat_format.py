"""Chat formatting: a fingerprint of nested field paths selects the mapping that makes canonical turns.

Rows may come as messages, prompt and response, or instruction records, as structs or as JSON text. The fingerprint
is a hash of the sorted paths of a row's fields; a table of declarative mappings says for each known fingerprint which
paths hold roles and texts. A struct's paths come from its schema and its fields are taken as they are; only JSON text
is parsed. The canonical form is array<struct<role, text>>. A template then writes the turns into one string, with the
texts' own control strings escaped so that reading back gives the same turns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all leaves; elements of an array are written []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(field_paths: Column) -> Column:
    """A hash of the set of paths; their order doesn't count."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(field_paths)), "\n"))


#: Strings in JSON may be as long as Spark's own; its reader stops at 20 million characters otherwise.
WHOLE = {"maxStringLen": str(2**31 - 1)}


def json_fields(value: Column) -> Column:
    """The fields of one JSON object, each as text, nulls left out; null if it is no object."""
    return F.map_filter(F.from_json(value, "map<string,string>", WHOLE), lambda _, v: v.isNotNull())


def json_paths(fields: Column) -> Column:
    """The paths of one row's JSON fields, to two levels: the keys, and those of the objects below them or in their arrays.

    Keys whose value is null count as absent, so that a row with "system": null has the layout of one without.
    """
    none = F.array().cast("array<string>")

    def below(key: Column, part: Column) -> Column:
        listed, nested = part.startswith("["), part.startswith("{")
        first = F.when(listed, F.coalesce(F.get(F.from_json(part, "array<string>", WHOLE), 0), F.lit(""))).otherwise(part)
        mark = F.when(listed, F.concat(key, F.lit("[]"))).otherwise(key)
        inner = F.when(listed | nested, F.coalesce(F.map_keys(F.from_json(first, "map<string,string>", WHOLE)), none)).otherwise(none)
        return F.when(F.size(inner) > 0, F.transform(inner, lambda k: F.concat(mark, F.lit("."), k))).otherwise(F.array(mark))

    return F.coalesce(F.flatten(F.transform(F.map_entries(fields), lambda e: below(e["key"], e["value"]))), none)


@dataclass(frozen=True)
class Layout:
    """A mapping. turns: (role, path) pairs in order, or one path of an array with its role and text fields.

    roles renames the source's roles. A null or absent text of an optional turn gives no turn; of others, an empty text.
    """

    field_paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def from_items(self, items: Column) -> Column:
        """Turns from an array of structs with the role and text fields."""
        roles = F.create_map(*(F.lit(x) for pair in self.roles for x in pair)) if self.roles else None

        def turn(m: Column) -> Column:
            role = m[self.role].cast("string")
            renamed = F.coalesce(F.try_element_at(roles, role), role) if self.roles else role
            return F.struct(F.coalesce(renamed, F.lit("")).alias("role"), F.coalesce(m[self.text].cast("string"), F.lit("")).alias("text"))

        return F.transform(items, turn)

    def from_fields(self, field: Callable[[str], Column]) -> Column:
        """Turns from one field each."""
        made = F.array(*(F.struct(F.lit(role).alias("role"), field(path).cast("string").alias("text"), F.lit(path in self.optional).alias("may")) for role, path in self.turns))
        stay = F.filter(made, lambda t: ~(t["may"] & (F.coalesce(t["text"], F.lit("")) == "")))
        return F.transform(stay, lambda t: F.struct(t["role"].alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    def from_struct(self, value: Column) -> Column:
        made = self.from_items(value[self.messages]) if self.messages else self.from_fields(lambda path: value[path])
        return F.when(value.isNotNull(), made)

    def from_json(self, fields: Column) -> Column:
        if self.messages:
            kind = f"array<struct<`{self.role}`:string,`{self.text}`:string>>"
            return self.from_items(F.from_json(F.try_element_at(fields, F.lit(self.messages)), kind, WHOLE))
        return self.from_fields(lambda path: F.try_element_at(fields, F.lit(path)))


FROM_VALUE = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout(("messages[].role", "messages[].content"), messages="messages"),
    Layout(("turns[].role", "turns[].text"), messages="turns", text="text"),
    Layout(("conversations[].from", "conversations[].value"), messages="conversations", role="from", text="value", roles=FROM_VALUE),
    Layout(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout(("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout(("system", "prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(("instruction", "input", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Layout(("question", "answer"), (("user", "question"), ("assistant", "answer"))),
)


def canonical_turns(rows: DataFrame, value: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds schema_print and turns from a column that holds a struct or JSON text.

    turns is null where no layout has the row's fingerprint, and where value is null: such rows stay and can be told. An
    unreadable JSON text has no paths, and so no layout. Columns of the two names are replaced. A text may be as long as
    a string of Spark's; in JSON text too.
    """
    rows = rows.drop("schema_print", "turns")
    kind = rows.schema[value].dataType
    if not isinstance(kind, T.StringType):
        print_ = fingerprint(F.array(*map(F.lit, paths(kind))))
        own = [layout for layout in layouts if set(layout.field_paths) == set(paths(kind))]
        turns = own[0].from_struct(F.col(value)) if own else F.lit(None)
        return rows.withColumn("schema_print", print_).withColumn("turns", turns.cast(TURNS))
    fields = f"{OWN}fields"
    made = rows.withColumn(fields, json_fields(F.col(value))).withColumn("schema_print", fingerprint(json_paths(F.col(fields))))
    turns = F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        known = fingerprint(F.array(*map(F.lit, layout.field_paths)))
        turns = F.when(F.col("schema_print") == known, layout.from_json(F.col(fields)).cast(TURNS)).otherwise(turns)
    return made.withColumn("turns", turns).drop(fields)


def escape(text: Column) -> Column:
    """One backslash more in each <\\...\\|, so that no <| is left; unescape takes it out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A backslash becomes \\e and a line end \\n, so that a role is one line; then as escape."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\e")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Behind a backslash stands e or n and nothing else, so one kind can be undone after the other.
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def render(turns: Column) -> Column:
    """Turns in one string: start mark, role, line end, text, end mark, line end."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), "")


def running(sizes: Column, block: int = 128) -> Column:
    """The sum of all sizes before each one. Sums are taken by blocks, as an array that grows by one is copied each time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))

    def before(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)
    made = F.flatten(F.zip_with(blocks, before(F.transform(blocks, total)), lambda b, at: F.transform(before(b), lambda x: x + at)))
    return F.when(F.size(sizes) > 0, made).otherwise(F.array().cast("array<long>"))


def pieces(formatted: Column) -> Column:
    """Per turn: role, the escaped text, and where that text lies in code points (begin from 0, length)."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.length(head(p)) + 2, F.length(p) - F.length(head(p)) - 2 - len(END))
    rows = F.transform(parts, lambda p: F.struct(head(p).alias("role"), body(p).alias("text"), (F.length(p) + len(START)).cast("long").alias("size")))

    def placed(own: Column) -> Column:
        starts = running(F.transform(own, lambda r: r["size"]))
        return F.zip_with(own, starts, lambda r, at: F.struct(r["role"].alias("role"), r["text"].alias("text"), (at + F.length(r["role"]) + 1 + len(START)).cast("int").alias("begin"), F.length(r["text"]).alias("length")))

    return F.element_at(F.transform(F.array(rows), placed), 1)


def in_loss(piece: Column) -> Column:
    """Whether a piece's text is learned."""
    return piece["role"] == "assistant"


def format_turns(rows: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds formatted (string) and loss_spans (begin and length in code points of each assistant text as it is written).

    Null turns give a null string; no turns give an empty one. Columns of these names are replaced. A text may be as
    long as Spark's strings are; a conversation's formatted string is one of them.
    """
    rows = rows.drop("formatted", "loss_spans").withColumn("formatted", render(F.col(turns)))
    own = F.filter(pieces(F.col("formatted")), in_loss)
    return rows.withColumn("loss_spans", F.transform(own, lambda p: F.struct(p["begin"].alias("begin"), p["length"].alias("length"))))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string."""
    return turns_of(pieces(formatted))


def turns_of(cut: Column) -> Column:
    """The turns of what pieces has cut."""
    return F.transform(cut, lambda p: F.struct(unescape_role(p["role"]).alias("role"), unescape(p["text"]).alias("text")))


def turns_from_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id and value, a struct whose turns[].role and turns[].text are in turn order.

    Equal turn numbers are ordered by role, then text; nulls come first; repeated rows stay. Null roles and texts are
    empty. A conversation is one row of the result, so it must fit a task; there is no limit on how many share a turn.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    return grouped.select("conv_id", F.struct(F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).alias("value"))
