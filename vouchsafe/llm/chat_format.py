"""Chat records of many layouts as canonical turns, and turns as training text with a loss mask.

A record's schema fingerprint is the digest of its nested field paths, as far as any layout knows them. It selects
a declared layout, which says where the turns are; a record with an unknown fingerprint keeps its row, with null
results. Turns are written in one template, in which control strings inside texts and roles are escaped so that
they can be read back exactly, and no control string of the output comes from a text.

Only DataFrame functions are used. Every step works on one record at a time, in time linear in its turns.

Defined cases: a null record, one that is no object and one of an unknown layout have the layout null and no
turns. A field that is JSON null, or missing where it is optional, gives no turn of its own, or an empty text in a
list of messages; a null role is empty. Empty texts are turns. An empty list of messages is a record without
turns, whose text is empty. Unknown fields never matter. Repeated records are records of their own.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import fresh_name

TURNS = "array<struct<role:string,text:string>>"
ASSISTANT = "assistant"

# ------------------------------------------------------------------ layouts


@dataclass(frozen=True)
class Field:
    """A turn whose text is in one field, with the text of a further one after it where there is one."""

    role: str
    path: str
    more: str | None = None
    optional: bool = False


@dataclass(frozen=True)
class Messages:
    """Turns from a list of objects. ``parts``: the text is a list of objects with a text each."""

    path: str
    role: str
    text: str
    parts: str | None = None
    names: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Layout:
    name: str
    turns: tuple[Field | Messages, ...]

    def required(self) -> set[str]:
        out = set()
        for turn in self.turns:
            if isinstance(turn, Messages):
                out |= {turn.path, f"{turn.path}[]"}
            elif not turn.optional:
                out.add(turn.path)
        return out

    def optional(self) -> list[set[str]]:
        """Sets of paths that are there together or not at all."""
        out = []
        for turn in self.turns:
            if isinstance(turn, Messages):
                text = f"{turn.path}[].{turn.text}"
                full = {f"{turn.path}[].{turn.role}", text}
                out.append(full | {f"{text}[]", f"{text}[].{turn.parts}"} if turn.parts else full)
            else:
                out += [{path} for path in (turn.path if turn.optional else None, turn.more) if path]
        return out

    def shapes(self) -> set[frozenset[str]]:
        """Every set of known paths that a record of this layout can have."""
        choices = itertools.product(*([set(), paths] for paths in self.optional()))
        return {frozenset(self.required().union(*choice)) for choice in choices}


_SYSTEM = Field("system", "system", optional=True)
_NAMES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}

#: The layouts known by default; where two could apply the first does.
LAYOUTS = (
    Layout("messages", (_SYSTEM, Messages("messages", "role", "content"))),
    Layout("message parts", (_SYSTEM, Messages("messages", "role", "content", parts="text"),)),
    Layout("conversations", (_SYSTEM, Messages("conversations", "from", "value", names=_NAMES))),
    Layout("prompt and response", (_SYSTEM, Field("user", "prompt"), Field(ASSISTANT, "response"))),
    Layout("prompt and completion", (_SYSTEM, Field("user", "prompt"), Field(ASSISTANT, "completion"))),
    Layout("instruction", (_SYSTEM, Field("user", "instruction", more="input"), Field(ASSISTANT, "output"))),
    Layout("question", (_SYSTEM, Field("user", "question", more="context"), Field(ASSISTANT, "answer"))),
    Layout("chat prompt", (Messages("prompt", "role", "content"), Field(ASSISTANT, "response"))),
)

_JOIN = "\n"#: Marks a list whose elements are of several kinds.
_MIXED = "~"


def _digest(paths: frozenset[str]) -> str:
    return hashlib.md5(_JOIN.join(sorted(paths)).encode()).hexdigest()


def _known_to(layout: Layout) -> list[str]:
    """The layout's paths, and those of lists where it has none, which tell it from others."""
    paths = set().union(*layout.shapes())
    return sorted(paths | {path + (_MIXED if path.endswith("[]") else "[]") for path in paths})


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def known_paths(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The nested field paths of a variant that some layout knows, sorted: ``messages[].role``."""
    known = _literals(sorted(set().union(*map(_known_to, layouts))))
    # A schema reads OBJECT<name: TYPE, `odd name`: ARRAY<TYPE>>.
    tokens = F.regexp_extract_all(
        F.schema_of_variant(record), F.lit(r"OBJECT<|ARRAY<|>|VARIANT|`(?:[^`]|``)*`: |\w+: "), F.lit(0)
    )
    nothing = F.array().cast("array<string>")
    start = F.struct(nothing.alias("above"), F.lit("").alias("at"), nothing.alias("paths"))

    def step(state: Column, token: Column) -> Column:
        above, at = state["above"], state["at"]
        name = F.concat(F.element_at(above, -1), F.regexp_replace(token, "^`|`?: $", ""))
        here = (
            F.when(token == "ARRAY<", F.concat(at, F.lit("[]")))
            .when(token == "VARIANT", F.concat(at, F.lit(_MIXED)))
            .when(token.endswith(": "), name)
            .otherwise(at)
        )
        prefix = F.when(at == "", at).otherwise(F.concat(at, F.lit(".")))
        return F.struct(
            F.when(token == "OBJECT<", F.array_append(above, prefix))
            .when(token == "ARRAY<", F.array_append(above, at))
            .when(token == ">", F.slice(above, 1, F.size(above) - 1))
            .otherwise(above).alias("above"),
            here.alias("at"),
            F.when(F.array_contains(known, here) & ~token.isin("OBJECT<", ">"), F.array_append(state["paths"], here))
            .otherwise(state["paths"]).alias("paths"),
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda state: state["paths"])))


def fingerprint(paths: Column, layout: Layout) -> Column:
    """The schema fingerprint, from the known paths of a record, as far as ``layout`` knows them."""
    return F.md5(F.array_join(F.array_intersect(paths, _literals(_known_to(layout))), _JOIN).cast("binary"))


def selected_layout(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The name of the first layout that has a record with these paths."""
    fits = [
        F.when(fingerprint(paths, layout).isin(sorted(map(_digest, layout.shapes()))), layout.name) for layout in layouts
    ]
    return F.coalesce(*fits)


# ------------------------------------------------------------------ canonical turns


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _field_turns(record: Column, turn: Field) -> Column:
    text = F.try_variant_get(record, f"$.{turn.path}", "string")
    whole = text
    if turn.more:
        more = F.try_variant_get(record, f"$.{turn.more}", "string")
        whole = F.when(F.length(more) > 0, F.concat_ws("\n\n", text, more)).otherwise(text)
    one = F.array(_turn(F.lit(turn.role), F.coalesce(whole, F.lit(""))))
    return F.when(text.isNull(), F.array().cast(TURNS)).otherwise(one) if turn.optional else one


def _message_turns(record: Column, turn: Messages) -> Column:
    text = f"array<struct<{turn.parts}:string>>" if turn.parts else "string"
    messages = F.try_variant_get(record, f"$.{turn.path}", f"array<struct<`{turn.role}`:string,`{turn.text}`:{text}>>")

    def canonical(message: Column) -> Column:
        role, said = F.coalesce(message[turn.role], F.lit("")), message[turn.text]
        if turn.parts:
            said = F.array_join(F.transform(said, lambda part: F.coalesce(part[turn.parts], F.lit(""))), "")
        for theirs, ours in turn.names.items():
            role = F.when(message[turn.role] == theirs, ours).otherwise(role)
        return _turn(role, F.coalesce(said, F.lit("")))

    return F.coalesce(F.transform(messages, canonical), F.array().cast(TURNS))


def layout_turns(record: Column, layout: Layout) -> Column:
    pieces = [
        _message_turns(record, turn) if isinstance(turn, Messages) else _field_turns(record, turn) for turn in layout.turns
    ]
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with the columns ``layout`` and ``turns`` (role and text, in order) of the variant ``record``."""
    paths = fresh_name(records, "_paths")
    found = records.withColumn(paths, known_paths(F.col(record), layouts))
    found = found.withColumn("layout", selected_layout(F.col(paths), layouts)).drop(paths)
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        turns = F.when(F.col("layout") == layout.name, layout_turns(F.col(record), layout)).otherwise(turns)
    return found.withColumn("turns", turns)


# ------------------------------------------------------------------ the template

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
# The template's and other common control strings, after their first character and any backslashes.
# None has a < or [ further on, so two can't overlap, and none can begin in a text and end in the template.
_FIRST = r"([<\[])"
_REST = r"(\\*(?:/?s>|/?INST\]|\|(?:turn|says|end|im_start|im_end|endoftext)\|>))"


def escaped(text: Column) -> Column:
    """A backslash after the first character of each control string, also of those that already have some there."""
    return F.regexp_replace(text, _FIRST + _REST, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\" + _REST, "$1$2")


def formatted(records: DataFrame, turns: str = "turns") -> DataFrame:
    """``records`` with ``formatted``, the turns in the template, and ``loss``, its mask.

    ``loss`` has one entry a turn: from which byte of the turn how many bytes of UTF-8 are trained on. Only what the
    assistant says is; the other turns have length 0.
    """
    safe = fresh_name(records, "_safe")

    def pieces(turn: Column) -> Column:
        head = F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit(MIDDLE))
        return F.struct(head.alias("head"), escaped(turn["text"]).alias("text"), turn["role"].alias("role"))

    def mask(turn: Column) -> Column:
        trained = F.when(turn["role"] == ASSISTANT, F.octet_length(turn["text"])).otherwise(0)
        return F.struct(F.octet_length(turn["head"]).alias("skip"), trained.alias("length"))

    segment = lambda turn: F.concat(turn["head"], turn["text"], F.lit(CLOSE))
    return (
        records.withColumn(safe, F.transform(turns, pieces))
        .withColumns({"formatted": F.array_join(F.transform(safe, segment), ""), "loss": F.transform(safe, mask)})
        .drop(safe)
    )


def segments(text: Column) -> Column:
    """The turns of a formatted text, each without its first mark."""
    return F.filter(F.split(text, r"<\|turn\|>"), lambda _, i: i > 0)


def read_back(text: Column) -> Column:
    """The turns (role and text) that a formatted text holds."""
    role = lambda part: F.substring_index(part, MIDDLE, 1)
    said = lambda part: F.substring_index(F.substring_index(part, MIDDLE, -1), CLOSE, 1)
    return F.transform(segments(text), lambda part: _turn(unescaped(role(part)), unescaped(said(part))))


def trained_text(text: Column, loss: Column) -> Column:
    """All that the mask covers, unescaped, in order."""

    def covered(part: Column, at: Column) -> Column:
        span = F.get(loss, at)
        skip = span["skip"] - len(OPEN.encode())
        return unescaped(F.substring(part.cast("binary"), skip + 1, span["length"]).cast("string"))

    return F.array_join(F.transform(segments(text), covered), "")
