r"""Chat formatting: layouts recognised by a schema fingerprint, one reversible template.

The nested field paths of a layout, sorted and hashed, are its fingerprint; that
of the most specific layout whose paths a record has selects a declarative
mapping from the record's layout to canonical turns ``(record, turn, role,
text)``.  All of it is DataFrame expressions.

The template writes a turn as ``### role: text</turn>`` and a newline.  Inside
texts and roles a backslash becomes ``\b``, ``###`` becomes ``\h`` and
``</turn>`` becomes ``\e`` (in roles also ``:`` becomes ``\c``), so that the
markers of the template never occur in them and the way back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
TEXT_ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))
TRAINED_ROLE = "assistant"


def escape(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for plain, coded in escapes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for plain, coded in reversed(escapes):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


@dataclass(frozen=True)
class Layout:
    """A layout: its field paths (``a[].b`` for fields in lists) and how its turns are made.

    ``rows``: the fields (record, turn, role, text) of a table of turns.
    ``turns``: the list field and the names of its role and text fields.
    ``fields``: a tuple of (role, field, ...), fields of a turn joined by newlines.
    """

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, ...], ...] = ()


LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("posts of a thread", ("author_role", "body", "position", "thread_id"), rows=("thread_id", "position", "author_role", "body")),
    Layout("messages", ("messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value")),
    Layout("instruction", ("input", "instruction", "output"), fields=(("user", "instruction", "input"), ("assistant", "output"))),
    Layout("instruction without input", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt and completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> Column:
    """The hash of a layout's nested field paths, in order."""
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def by_specificity(layouts) -> list[Layout]:
    """The layouts with the most paths first, equal ones in their declared order."""
    return sorted(layouts, key=lambda x: -len(x.paths))


def _has_path(record: Column, json: Column, path: str) -> Column:
    """Whether a JSON record has a field; a field in a list counts if any element of the list has it."""
    here = F.variant_get(record, "$." + path.replace("[]", "[0]"), "variant").isNotNull()
    field, in_list, sub = path.partition("[].")
    if not in_list:
        return here
    items = F.from_json(json, f"struct<`{field}`:array<map<string,string>>>")[field]
    return here | F.coalesce(F.exists(items, lambda x: F.coalesce(F.map_contains_key(x, F.lit(sub)), F.lit(False))), F.lit(False))


def json_fingerprint(json: Column, layouts=LAYOUTS) -> Column:
    """The fingerprint of the most specific layout whose field paths a JSON record has, ties by declared order; null without one.

    Further fields, those of other layouts too, are no hindrance.
    """
    record = F.try_parse_json(json)
    layouts = [x for x in layouts if not x.rows]
    paths = sorted({p for x in layouts for p in x.paths})
    have = F.array_compact(F.array(*(F.when(_has_path(record, json, p), F.lit(p)) for p in paths)))
    marks = [F.when(F.size(F.array_except(F.array(*map(F.lit, x.paths)), have)) == 0, fingerprint(x.paths)) for x in by_specificity(layouts)]
    return F.coalesce(*marks)


def schema_paths(schema: T.StructType) -> list[str]:
    """The nested field paths of a table."""

    def walk(kind: T.DataType, path: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f"{path}.{f.name}" if path else f.name)]
        return walk(kind.elementType, path + "[]") if isinstance(kind, T.ArrayType) else [path]

    return sorted(walk(schema, ""))


def turns_of_rows(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Canonical turns of a table of turns, by the mapping that the fingerprint of its field paths selects.

    Of the layouts whose field paths the table has, the most specific one gives
    the fingerprint, ties by declared order; further columns, those of other
    layouts too, are ignored.  A table that has no layout's paths is an error.
    """
    have = set(schema_paths(df.schema))
    possible = [x for x in by_specificity(layouts) if x.rows and have >= set(x.paths)]
    if not possible:
        raise ValueError(f"no layout has these field paths: {sorted(have)}")
    mark = fingerprint(possible[0].paths)
    names = ("record", "turn", "role", "text")
    return df.select(*(F.coalesce(*(F.when(mark == fingerprint(x.paths), F.col(x.rows[k])) for x in possible)).alias(n) for k, n in enumerate(names)))


def _turns(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))


def turns_of_json(df: DataFrame, record: str, json: str, layouts=LAYOUTS) -> DataFrame:
    """Canonical turns of JSON records, each by the mapping that its own fingerprint selects.

    Null field values are empty texts; fields beyond those of the layout are ignored.
    A record that is null, no JSON, too large for a variant or of no known
    layout keeps one row with a null turn, role and text.
    """
    turn = "struct<role:string,text:string>"
    source = df.select(F.col(record).alias("record"), F.col(json).alias("json")).withColumn("mark", json_fingerprint(F.col("json"), layouts))
    made = F.lit(None).cast(f"array<{turn}>")
    for layout in layouts:
        if layout.turns:
            field, role, text = layout.turns
            own = F.from_json("json", f"struct<`{field}`:array<struct<`{role}`:string,`{text}`:string>>>")[field]
            own = _turns(own, role, text)
        elif layout.fields:
            names = [f for x in layout.fields for f in x[1:]]
            parsed = F.from_json("json", "struct<" + ",".join(f"`{f}`:string" for f in names) + ">")
            own = F.array(
                *(F.struct(F.lit(x[0]).alias("role"), F.array_join(F.filter(F.array(*(parsed[f] for f in x[1:])), lambda v: v != ""), "\n").alias("text")) for x in layout.fields)
            )
        else:
            continue
        made = F.when(F.col("mark") == fingerprint(layout.paths), own).otherwise(made)
    rows = source.select("record", F.posexplode_outer(made).alias("turn", "x")).select("record", F.col("turn").cast("long").alias("turn"), "x.role", "x.text")
    same = F.create_map(*(F.lit(v) for pair in ROLES.items() for v in pair))
    return rows.withColumn("role", F.coalesce(same[F.lower("role")], "role")).withColumn("text", F.when(F.col("turn").isNotNull(), F.coalesce("text", F.lit(""))))


def format_turns(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``(record, formatted, loss_spans)``: one training text per record.

    ``loss_spans`` lists the code points under the loss mask as (start,
    length).  Turns go by turn number, then role and text, nulls first; null
    roles and texts are empty; repeated rows are repeated turns; rows with a
    null record form one record.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    opened = F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(AFTER_ROLE))
    coded = escape(F.coalesce(F.col("text"), F.lit("")))
    rows = turns.select("record", "turn", role.alias("role"), opened.alias("opened"), coded.alias("coded"))
    size = F.length("opened") + F.length("coded") + F.lit(len(CLOSE))
    so_far = Window.partitionBy("record").orderBy("turn", "role", "coded").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(size).over(so_far), F.lit(0)))
    span = F.when(F.col("role") == trained_role, F.struct((F.col("at") + F.length("opened")).alias("start"), F.length("coded").cast("long").alias("length")))
    parts = F.sort_array(F.collect_list(F.struct("at", F.concat("opened", "coded", F.lit(CLOSE)).alias("part"))))
    grouped = placed.groupBy("record").agg(parts.alias("parts"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return grouped.select("record", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), "loss_spans")


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped: the exact way back."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        at = F.call_function("instr", body, F.lit(AFTER_ROLE))
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1), ROLE_ESCAPES).alias("role"), unescape(F.substr(body, at + len(AFTER_ROLE))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing in between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
