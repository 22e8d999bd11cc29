"""Chat formatting with typed content parts, by DataFrame functions alone.

A message's content is an array of parts: struct<type: string, text: string, ref: string, units: long>. A visitor
goes through them in order, by their type: text that stands side by side is joined and then escaped, so that no control
string can be put together from parts; image, audio and document parts become placeholders of their kind, turn and
place, no two alike in a conversation, and are recorded in ``attachments`` with their placeholder, their reference and the
tokens that they expand to. The template is

    <|turn|>role\\n content <|end|>

(without the spaces), turn after turn. A control string inside a text or a role gets a backslash after its first
character, and one that already has backslashes there gets one more, so that formatted text holds control strings
only where the template put them and unescape() gives back every text, whatever it holds.

Cases: null text or role is empty; a part of unknown or null type is read as text; a null or empty content is an
empty turn; turns of one conversation come in the order of turn (nulls first), then role, then content, so repeated rows stay,
side by side; rows with null conv_id form one conversation; an empty table gives an empty result; further columns
are ignored. One conversation is one row of the result, so its turns meet in one task by nature: a conversation is bounded by
what a model reads, and the turns of many conversations are spread by conv_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Tokens of one unit of each kind of attachment: an image tile, a second of sound, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
#: What must not stand unescaped inside a text: <| begins every control string of the template; the rest are the
#: marks of other common templates. Between its first character and this tail, text may have any number of backslashes.
TAIL = r"(\||/?s>|/?INST\])"
NEWLINE = "<|nl|>"

PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, r"$1$2$3")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def is_file(part: Column, unit_tokens: dict[str, int] = UNIT_TOKENS) -> Column:
    return F.coalesce(part["type"].isin(list(unit_tokens)), F.lit(False))


def placeholder(part: Column, turn_no: Column, nth: Column) -> Column:
    return F.concat(F.lit("<|"), part["type"], F.lit("_"), turn_no.cast("string"), F.lit("."), nth.cast("string"), F.lit("|>"))


def visit(parts: Column, turn_no: Column, unit_tokens: dict[str, int] = UNIT_TOKENS) -> Column:
    """The text that a turn's parts make. Text waits in open until a file or the end follows, and is escaped as one."""
    marked = F.transform(parts, lambda p, i: F.struct(F.when(is_file(p, unit_tokens), placeholder(p, turn_no, i)).alias("mark"), F.coalesce(p["text"], F.lit("")).alias("text")))
    empty = F.struct(F.lit("").alias("shown"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        file = p["mark"].isNotNull()
        shown = F.when(file, F.concat(acc["shown"], escape(acc["open"]), p["mark"])).otherwise(acc["shown"])
        return F.struct(shown.alias("shown"), F.when(file, F.lit("")).otherwise(F.concat(acc["open"], p["text"])).alias("open"))

    return F.aggregate(marked, empty, step, lambda acc: F.concat(acc["shown"], escape(acc["open"])))


def attachments(parts: Column, turn_no: Column, unit_tokens: dict[str, int] = UNIT_TOKENS) -> Column:
    """array<struct<turn_no, placeholder, kind, ref, tokens>> of a turn's files."""

    def one(p: Column, i: Column) -> Column:
        tokens = F.lit(None).cast("bigint")
        for kind, each in unit_tokens.items():
            tokens = F.when(p["type"] == kind, F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(0)) * each).otherwise(tokens)
        found = F.struct(turn_no.cast("int").alias("turn_no"), placeholder(p, turn_no, i).alias("placeholder"), p["type"].alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))
        return F.when(is_file(p, unit_tokens), found)

    return F.filter(F.transform(parts, one), lambda x: x.isNotNull())


def format_chats(messages: DataFrame, unit_tokens: dict[str, int] = UNIT_TOKENS, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, content array<PART>) -> conv_id, n_turns, formatted, loss array<struct<start, end>> (places
    in code points of formatted, of what loss_role says), attachments array<struct<turn_no, placeholder, kind, ref,
    tokens>>, attachment_tokens."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.array().cast(f"array<{PART}>")).alias("content"))
    one = F.struct("turn", "role", "content")
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def render(t: Column, i: Column) -> Column:
        body = visit(t["content"], i, unit_tokens)
        head = F.concat(F.lit(TURN), F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        return F.struct(head.alias("head"), body.alias("body"), (t["role"] == loss_role).alias("loss"), attachments(t["content"], i, unit_tokens).alias("files"))

    # lengths are taken of what is rendered, in a projection of their own: each text is made once
    done = convs.select("conv_id", F.transform("turns", render).alias("r"))
    text = F.concat_ws("", F.transform("r", lambda x: F.concat(x["head"], x["body"], F.lit(END))))
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
        return F.struct((b + len(END)).cast("int").alias("at"), F.when(x["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    files = F.flatten(F.transform("r", lambda x: x["files"]))
    out = done.select("conv_id", F.size("r").cast("long").alias("n_turns"), text.alias("formatted"), F.aggregate("r", zero, step)["spans"].alias("loss"), files.alias("attachments"))
    total = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, f: a + F.coalesce(f["tokens"], F.lit(0).cast("bigint")))
    return out.withColumn("attachment_tokens", total)


def read_back(formatted: Column) -> Column:
    """formatted -> array<struct<role, text>>, unescaped (placeholders of attachments stay as they are)."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")

    def one(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END))
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))))
