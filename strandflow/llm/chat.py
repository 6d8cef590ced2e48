"""Chat formatting: schema fingerprints select declarative mappings into canonical turns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates: an opening character, then one of these.  Between the two, escaped text has
#: one backslash more than the text itself, so it holds none of them and nothing is lost.
OPEN, REST = r"([<\[])", r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    items: path of an array whose elements have role and text fields; or parts: (role, fields) in order, the
    fields' non-empty texts joined by an empty line.
    """

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> list[str]:
        if self.items:
            return sorted((f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"))
        return sorted(p for _, fields in self.parts for p in fields)


ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
MAPPINGS = [
    Mapping("messages", "messages", "role", "content"),
    Mapping("nested_messages", "data.messages", "role", "content"),
    Mapping("from_value", "conversations", "from", "value", roles=ALIASES),
    Mapping("speaker_text", "turns", "speaker", "text", roles=ALIASES),
    Mapping("prompt_response", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system_prompt_response", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction_output", parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input_output", parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question_answer", parts=(("user", ("question",)), ("assistant", ("answer",)))),
]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, OPEN + r"(\\*)" + REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, OPEN + r"\\(\\*)" + REST, "$1$2$3")


def _role_out(role: Column) -> Column:
    """A role stands in one line: backslashes and line feeds are escaped as well."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "array<variant>")


def _has(v: Column, path: str) -> Column:
    if "[]." in path:
        items, leaf = path.split("[].")
        return F.coalesce(F.exists(_items(v, items), lambda x: F.try_variant_get(x, f"$.{leaf}", "variant").isNotNull()), F.lit(False))
    return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()


def _fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.concat_ws("\n", paths))


def _text_at(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))


def _item_turns(m: Mapping, v: Column) -> Column:
    def turn(x: Column) -> Column:
        said = role = _text_at(x, m.role)
        for name, known in m.roles.items():
            role = F.when(F.lower(said) == name, F.lit(known)).otherwise(role)
        return F.struct(role.alias("role"), _text_at(x, m.text).alias("text"))

    return F.transform(_items(v, m.items), turn)


def _part_turns(m: Mapping, v: Column) -> Column:
    def turn(role: str, fields: tuple[str, ...]) -> Column:
        texts = F.filter(F.array(*[_text_at(v, p) for p in fields]), lambda s: s != "")
        return F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text"))

    return F.array(*[turn(role, fields) for role, fields in m.parts])


def canonical_turns(records: DataFrame, mappings: list[Mapping] = MAPPINGS, id_col: str = "conv_id",
                    record_col: str = "record") -> DataFrame:
    """Rows (conv_id, record) -> (conv_id, layout, fingerprint, turns array<struct<role, text>>).

    record is JSON text or a variant.  The field paths known to any mapping that a record has, sorted and hashed,
    are its fingerprint, which selects the mapping; other fields don't matter.
    A null, broken or unknown record has a null layout and no turns.  Null roles and texts are empty.
    """
    known = sorted({p for m in mappings for p in m.paths})
    is_text = dict(records.dtypes)[record_col] == "string"
    v = F.try_parse_json(F.col(record_col)) if is_text else F.col(record_col)
    out = records.select(F.col(id_col).alias("conv_id"), v.alias("v"))
    paths = F.array_compact(F.array(*[F.when(_has(F.col("v"), p), F.lit(p)) for p in known]))
    out = out.withColumn("fingerprint", _fingerprint(paths))
    none = "array<struct<role:string,text:string>>"
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(none)
    for m in mappings:
        own = _item_turns(m, F.col("v")) if m.items else _part_turns(m, F.col("v"))
        hit = F.col("fingerprint") == _fingerprint(F.array(*[F.lit(p) for p in m.paths]))
        layout, turns = F.when(hit, F.lit(m.name)).otherwise(layout), F.when(hit, own.cast(none)).otherwise(turns)
    return out.select("conv_id", layout.alias("layout"), "fingerprint", F.coalesce(turns, F.array().cast(none)).alias("turns"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds formatted (the template's text) and loss (spans start, len in code points of the assistant's texts).

    A turn is <|im_start|>role, line feed, text, <|im_end|>, line feed; control strings of this and other
    templates inside roles and texts are escaped reversibly.  No turns give an empty text and no spans.
    """
    piece = lambda t: F.struct(
        F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("learn"))
    out = turns.withColumn("_p", F.transform("turns", piece))
    tail = END + "\n"
    out = out.withColumn("formatted", F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), ""))
    spans = F.aggregate(
        "_p", F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,len:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["pos"] + F.length(p["head"]) + F.length(p["body"]) + len(tail)).alias("pos"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["pos"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("len")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return out.withColumn("loss", spans).drop("_p")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the output itself says: read_turns, and read_loss, the unescaped texts under the loss mask in order."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    role = lambda p: F.substring_index(body(p), "\n", 1)
    turn = lambda p: F.struct(
        _role_in(role(p)).alias("role"), unescape(F.substr(body(p), F.length(role(p)) + 2)).alias("text"))
    out = formatted.withColumn("read_turns", F.transform(parts, turn))
    under = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["len"])))
    return out.withColumn("read_loss", F.array_join(under, ""))


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """Rows by turn -> one record (variant) per conversation in the messages layout.

    Turns are ordered by number, then role and text, so rows that repeat stay and ties are settled; a null number
    comes first, null ids are one conversation.  A record is one row by nature and is as long as its conversation.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                    F.coalesce(text_col, F.lit("")).alias("content"))
    got = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return got.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the query returns, taken from read_back()."""
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id", "layout", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("read_loss").cast("long").alias("loss_chars"), F.sha2(F.col("read_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
