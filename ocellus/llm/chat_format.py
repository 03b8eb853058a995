"""Chat formatting: heterogeneous layouts to one marked-up string with a loss mask.

A layout is known by its fingerprint, the hash of its nested field paths.
Tables are fingerprinted from their schema, JSON records row by row from the
paths they hold.  The fingerprint selects a declarative mapping to canonical
turns (conv_id, turn, role, text).  All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: The template's control strings (opening, closing) by role; other roles are named inside [ROLE].
MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
ROLE_MARKS = ("[ROLE] ", " [/ROLE] ", " </s>")
#: A control string inside a text gets a backslash behind its first character; a backslash gets another.
CONTROL = r"([<\[])(/?s>|/?INST\]|/?ROLE\]|<SYS>>|</SYS>>)"
TURN = r"(?s)<<SYS>> .*? <</SYS>>|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE\] .*? \[/ROLE\] .*? </s>"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping.

    ``paths`` must be present and ``optional`` may be.  Either ``turns`` lists
    (role, fields joined by a blank line), or ``items`` names an array with its
    role and text fields; ``roles`` maps the layout's role names.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


ROLE_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("prompter", "user"))
RECORDS = [
    Layout("messages", ("messages[].role",), ("messages[].content", "system"), items=("messages", "role", "content"), roles=ROLE_NAMES),
    Layout("conversations", ("conversations[].from",), ("conversations[].value", "system"), items=("conversations", "from", "value"), roles=ROLE_NAMES),
    Layout("instruction", ("instruction", "output"), ("input", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_response", ("instruction", "response"), ("context", "input", "system"), turns=(("system", ("system",)), ("user", ("context", "instruction", "input")), ("assistant", ("response",)))),
    Layout("prompt_response", ("prompt", "response"), ("context", "system"), turns=(("system", ("system",)), ("user", ("context", "prompt")), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("context", "system"), turns=(("system", ("system",)), ("user", ("context", "prompt")), ("assistant", ("completion",)))),
    Layout("question_answer", ("question", "answer"), ("context", "system"), turns=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
]
TABLES = [Layout("turn_rows", ("conv_id", "turn", "role", "text"))]
RECORD_SCHEMA = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, instruction string, input string, output string, "
    "prompt string, response string, completion string, question string, answer string, context string, system string"
)


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def known_paths(layouts: list[Layout]) -> list[str]:
    return sorted({p for x in layouts for p in (*x.paths, *x.optional)})


def registry(layouts: list[Layout]) -> dict[str, str]:
    """Fingerprint to layout name, for each choice of a layout's optional paths."""
    return {fingerprint((*x.paths, *some)): x.name for x in layouts for some in chain.from_iterable(combinations(x.optional, n) for n in range(len(x.optional) + 1))}


def schema_paths(schema: StructType) -> set[str]:
    """Nested field paths of a table; ``[]`` marks the elements of an array."""

    def walk(kind, prefix: str) -> Iterable[str]:
        if isinstance(kind, StructType):
            for f in kind.fields:
                yield from walk(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
        elif isinstance(kind, ArrayType):
            yield from walk(kind.elementType, f"{prefix}[]")
        else:
            yield prefix

    return set(walk(schema, ""))


def table_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table with a known layout; other columns are left out.

    The fingerprint is taken over the paths that some table layout knows, so
    extra columns do not change it.
    """
    found = registry(TABLES).get(fingerprint(schema_paths(df.schema) & set(known_paths(TABLES))))
    if found is None:
        raise ValueError(f"no table layout has the fields {sorted(schema_paths(df.schema))}")
    return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))


def _present(record: Column, path: str) -> Column:
    array, _, name = path.partition("[].")
    if name:
        return F.coalesce(F.exists(record[array], lambda x: x[name].isNotNull()), F.lit(False))
    return record[path].isNotNull()


def record_layout(record: Column) -> Column:
    """Name of a parsed record's layout; null if unknown.

    A layout's fingerprint is taken over its own paths only, so fields of
    other layouts don't hide it.  Of several that fit, the first in
    ``RECORDS`` is chosen, and fields that it doesn't map are left out.
    """
    found = F.lit(None).cast("string")
    for layout in reversed(RECORDS):
        held = F.array_compact(F.array(*[F.when(_present(record, p), F.lit(p)) for p in known_paths([layout])]))
        fits = F.sha2(F.concat_ws("\n", held).cast("binary"), 256).isin(*registry([layout]))
        found = F.when(fits, F.lit(layout.name)).otherwise(found)
    return found


def _record_turns(record: Column, layout: Layout) -> Column:
    kind = "array<struct<role:string,text:string>>"
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    if layout.items:
        array, role, text = layout.items

        def named(x: Column) -> Column:
            out = F.coalesce(x[role], F.lit(""))
            for theirs, ours in layout.roles:
                out = F.when(x[role] == theirs, F.lit(ours)).otherwise(out)
            return out

        system = F.when(record["system"].isNotNull(), F.array(turn(F.lit("system"), record["system"]))).otherwise(F.array().cast(kind))
        return F.concat(system, F.transform(record[array], lambda x: turn(named(x), F.coalesce(x[text], F.lit("")))).cast(kind))
    made = [F.when(F.coalesce(*[record[f] for f in fields]).isNotNull(), turn(F.lit(role), F.concat_ws("\n\n", *[record[f] for f in fields]))) for role, fields in layout.turns]
    return F.array_compact(F.array(*made)).cast(kind)


def _parsed(df: DataFrame, conv_id: str, record: str) -> DataFrame:
    """conv_id, the record as text and parsed, and its layout."""
    parsed = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(record).alias("record"), F.from_json(F.col(record), RECORD_SCHEMA).alias("r"))
    return parsed.withColumn("layout", record_layout(F.col("r")))


def record_turns(df: DataFrame, conv_id: str, record: str) -> DataFrame:
    """Canonical turns of JSON records of any known layout.

    A record that is null, is no JSON, or has an unknown layout has no turns;
    :func:`unmatched_records` returns those.
    """
    named = _parsed(df, conv_id, record)
    turns = F.array().cast("array<struct<role:string,text:string>>")
    for layout in RECORDS:
        turns = F.when(F.col("layout") == layout.name, _record_turns(F.col("r"), layout)).otherwise(turns)
    return named.select("conv_id", F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def unmatched_records(df: DataFrame, conv_id: str, record: str) -> DataFrame:
    """conv_id and record of each row without turns in :func:`record_turns`: null, no JSON, or of no known layout."""
    return _parsed(df, conv_id, record).where("layout IS NULL").select("conv_id", "record")


def escape(text: Column) -> Column:
    """A text without control strings, from which :func:`unescape` makes the text."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def marked(role: Column, text: Column) -> Column:
    """A turn with its marks."""
    out = F.concat(F.lit(ROLE_MARKS[0]), escape(role), F.lit(ROLE_MARKS[1]), escape(text), F.lit(ROLE_MARKS[2]))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(a), escape(text), F.lit(b))).otherwise(out)
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string and loss mask: spans (start, length) of code points.

    Turns are ordered by turn, then role, then text.  Null roles and texts are
    empty; turns with a null conv_id form one conversation.  A conversation is
    one value of the result and so is put together by one task; the places of
    its spans come from a running sum over its turns, not from a fold.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = clean.withColumn("part", marked(F.col("role"), F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    opening, closing = (len(x) for x in MARKS["assistant"])
    size = F.char_length("part")
    placed = each.select(
        "conv_id", "part", F.row_number().over(order).alias("n"),
        F.when(F.col("role") == "assistant", F.struct((F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + opening).cast("int").alias("start"), (size - opening - closing).alias("length"))).alias("span"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "part", "span"))).alias("parts"))
    return whole.select("conv_id", F.concat_ws("", F.transform("parts", lambda p: p["part"])).alias("formatted"), F.array_compact(F.transform("parts", lambda p: p["span"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts, read from the formatted string and its mask."""

    def turn(part: Column) -> Column:
        text = lambda a, b: F.substring(part, F.lit(a + 1), F.char_length(part) - a - b)
        role = F.regexp_extract(part, r"(?s)^\[ROLE\] (.*?) \[/ROLE\] ", 1)
        named = F.char_length(role) + len(ROLE_MARKS[0]) + len(ROLE_MARKS[1])
        out = F.struct(unescape(role).alias("role"), unescape(F.substring(part, named + 1, F.char_length(part) - named - len(ROLE_MARKS[2]))).alias("text"))
        for name, (a, b) in MARKS.items():
            out = F.when(part.startswith(a), F.struct(F.lit(name).alias("role"), unescape(text(len(a), len(b))).alias("text"))).otherwise(out)
        return out

    parts = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    return formatted.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss_texts"))
