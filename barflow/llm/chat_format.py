"""Chat formatting with schema fingerprints, in DataFrame and SQL functions only.

``fingerprint`` hashes the sorted nested field paths of a table; ``MAPPINGS`` holds one declarative mapping per known
layout, keyed by that hash.  ``canonical_turns`` picks the mapping and gives rows (conv_id, pos, role, text), whatever the
layout: one row per turn, prompt/response, instruction/input/output, or arrays of messages.  ``json_turns`` does the same
for a column of JSON objects whose layout differs from row to row.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside roles and texts every ``<`` + n backslashes + ``|``
gets one more backslash, so no control string can occur there; ``unescape`` takes it away again.  In roles, line breaks
are written as ``%0A`` and ``%`` as ``%25``.

Null roles and texts count as empty.  Turns are ordered by turn, then role, then text (nulls first), so ties and repeated
rows have one order.  Rows with a null conversation id form one conversation of their own.  A conversation is one output
row, so its length is bounded by what one string can hold (2 GB); nothing else is gathered.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``rows``: (turn column, role column, text column) of a table with one row per turn.
    ``items``: (array column, role field, text field) of an array of messages.
    ``fields``: (role, columns joined by a blank line) for fixed turns; empty ones are left out, except the last.
    """

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Mapping("turn_rows", ("role", "text", "turn"), rows=("turn", "role", "text")),
    Mapping("turn_rows_content", ("content", "role", "turn"), rows=("turn", "role", "content")),
    Mapping("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Mapping("share_turns", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system_prompt_response", ("prompt", "response", "system"),
            fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("input", "instruction", "output"),
            fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths in dotted form; an array adds ``[]``."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = {fingerprint(m.paths): m for m in LAYOUTS}


def mapping_for(schema: T.StructType, id_col: str = "conv_id") -> Mapping:
    """The mapping whose fingerprint the schema has; failing that, the largest layout whose paths it all has."""
    paths = [p for p in field_paths(schema) if p != id_col]
    exact = MAPPINGS.get(fingerprint(paths))
    if exact:
        return exact
    fit = [m for m in LAYOUTS if set(m.paths) <= set(paths)]
    if not fit:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return max(fit, key=lambda m: (len(m.paths), m.name))


def _text(c) -> Column:
    return F.coalesce((c if isinstance(c, Column) else F.col(f"`{c}`")).cast("string"), F.lit(""))


def _role(c: Column) -> Column:
    out = c
    for known, role in ROLES.items():
        out = F.when(F.lower(c) == known, F.lit(role)).otherwise(out)
    return out


def _turn(role, text) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _message_turns(messages: Column, role: str, text: str) -> Column:
    return F.transform(messages, lambda x: _turn(_role(_text(x[role])), _text(x[text])))


def _fixed_turns(m: Mapping, get) -> Column:
    """Array of turns for a mapping of fixed fields; ``get`` gives a column for a field name."""
    turns = []
    for role, cols in m.fields:
        parts = F.filter(F.array(*[F.coalesce(get(c).cast("string"), F.lit("")) for c in cols]), lambda t: t != "")
        turns.append(_turn(F.lit(role), F.array_join(parts, "\n\n")))
    last = turns[-1]
    return F.concat(F.filter(F.array(*turns[:-1]), lambda t: t["text"] != ""), F.array(last))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout."""
    m = mapping_for(df.schema, id_col)
    key = F.col(f"`{id_col}`").alias("conv_id")
    if m.rows:
        turn, role, text = m.rows
        return df.select(key, F.col(f"`{turn}`").alias("turn"), _text(role).alias("role"), _text(text).alias("text"))
    if m.items:
        field, role, text = m.items
        turns = _message_turns(F.col(f"`{field}`"), role, text)
    else:
        turns = _fixed_turns(m, lambda c: F.col(f"`{c}`"))
    return df.select(key, F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("bigint"), "t.role", "t.text")


JSON_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                            ("system", "prompt", "response", "completion", "question", "answer", "instruction", "input", "output")]
                           + [T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
                              T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])))])


def json_turns(df: DataFrame, payload: str = "payload", id_col: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turn, role, text) of JSON objects whose layouts differ; one row with null turn where none fits.

    Each row's own paths are hashed and looked up among the fingerprints of the mappings.
    """
    j = F.from_json(F.col(f"`{payload}`"), JSON_SCHEMA)
    own = []
    for f in JSON_SCHEMA:
        for p in field_paths(f.dataType, f.name):
            own.append(F.when(F.col("_j")[f.name].isNotNull(), F.lit(p)))
    d = df.select(F.col(f"`{id_col}`").alias("conv_id"), j.alias("_j"))
    d = d.withColumn("_key", F.sha2(F.array_join(F.array_sort(F.array_compact(F.array(*own))), "\n"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for key, m in MAPPINGS.items():
        if m.rows:
            continue
        if m.items:
            field, role, text = m.items
            made = _message_turns(F.col("_j")[field], role, text)
        else:
            made = _fixed_turns(m, F.col("_j").getField)
        layout, turns = F.when(F.col("_key") == key, F.lit(m.name)).otherwise(layout), F.when(F.col("_key") == key, made).otherwise(turns)
    d = d.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
    return d.select("conv_id", "layout", F.col("turn").cast("bigint"), "t.role", "t.text")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", "<$1|")


def _escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, spans): the training string and, for each turn, where it and its trained text lie.

    ``spans`` holds code-point offsets (turn_start, loss_start, loss_end) in turn order; an untrained turn has an empty
    loss span.
    """
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("head", head).withColumn("body", escape(F.col("text")))
    t = t.select("conv_id", "turn", "role", "text", F.col("role").isin(list(trained)).alias("on"), F.length("head").alias("h"),
                 F.length("body").cast("bigint").alias("b"), F.concat("head", "body", F.lit(END + "\n")).alias("piece"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(w))
    t = t.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.col("at") + F.col("h")
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "piece", F.col("at").alias("turn_start"), first.alias("loss_start"),
        F.when(F.col("on"), first + F.col("b")).otherwise(first).alias("loss_end")))).alias("all"))
    return g.select("conv_id", F.array_join(F.col("all.piece"), "").alias("formatted"),
                    F.transform("all", lambda x: F.struct(x["turn_start"], x["loss_start"], x["loss_end"])).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) parsed from :func:`render`'s output alone."""
    pieces = F.filter(F.split("formatted", r"(?<=<\|im_end\|>\n)"), lambda p: p != "")
    d = formatted.select("conv_id", "spans", F.length("formatted").cast("bigint").alias("formatted_chars"), pieces.alias("pieces"))

    def parse(p: Column) -> Column:
        body = F.substring(p, F.lit(len(START) + 1), F.length(p) - len(START) - len(END) - 1)
        cut = F.instr(body, "\n")
        return F.struct(_unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substring(body, cut + 1, F.length(body))).alias("text"))

    def loss(p: Column, s: Column) -> Column:
        n = (s["loss_end"] - s["loss_start"]).cast("int")
        return unescape(F.substring(p, (s["loss_start"] - s["turn_start"] + 1).cast("int"), n))

    return d.select("conv_id", "formatted_chars", F.transform("pieces", parse).alias("turns"),
                    F.array_join(F.zip_with("pieces", "spans", loss), "").alias("loss_text"))


def format_digests(turns: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of what :func:`read_back` finds in the formatted output."""
    back = read_back(render(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("bigint").alias("loss_chars"),
                       F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
