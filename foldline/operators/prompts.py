"""Separator styles: what a prompt starts with and what each turn adds to it.

A style is three column builders over one turn ``c``: the head of the prompt, a turn with text, and a turn
still waiting for text. Turns are numbered from 0, with a template's example turns first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column, functions as F

# The image marker and the pieces of text that belong to one style each.
IMAGE_MARK = "$$<image>$$"
LLAMA3_OPEN, LLAMA3_CLOSE, LLAMA3_END = "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"
GEMMA_START, GEMMA_TURN = "<bos>", "<start_of_turn>"
YUAN2_MARK = "<n>"


def cat(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def given(condition: Column, text: Column, otherwise: Column | str = "") -> Column:
    return F.when(condition, text).otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


Piece = Callable[[SimpleNamespace], Column]


@dataclass(frozen=True)
class Style:
    head: Piece
    turn: Piece
    pending: Piece
    images: bool = False


def _prompt_and_sep(c):
    return cat(c.prompt, c.sep)


def _prompt(c):
    return c.prompt


def _if_prompt(*after: str) -> Piece:
    return lambda c: given(c.prompt != "", cat(c.prompt, c.sep, *after))


def _role(*after: str) -> Piece:
    return lambda c: cat(c.role, *after)


def _header(c):
    return cat(LLAMA3_OPEN, c.role, LLAMA3_CLOSE)


def _tag(c):
    """The role name by position, whatever role the turn carries."""
    return given(c.even, c.roles[0], c.roles[1])


def _round(c):
    first = given(c.template == "chatglm2", F.lit(1), F.lit(0))
    return given(c.even, cat("[Round ", (F.floor(c.i / 2) + first).cast("string"), "]", c.sep))


STYLES: dict[str, Style] = {
    "ADD_COLON_SINGLE": Style(_prompt_and_sep, lambda c: cat(c.role, ": ", c.text, c.sep), _role(":")),
    "ADD_COLON_TWO": Style(_prompt_and_sep, lambda c: cat(c.role, ": ", c.text, c.sep_i), _role(":"), images=True),
    "ADD_COLON_SPACE_SINGLE": Style(_prompt_and_sep, lambda c: cat(c.role, ": ", c.text, c.sep), _role(": ")),
    "NO_COLON_SINGLE": Style(_prompt, lambda c: cat(c.role, c.text, c.sep), _role()),
    "NO_COLON_TWO": Style(_prompt, lambda c: cat(c.role, c.text, c.sep_i), _role()),
    "ADD_NEW_LINE_SINGLE": Style(_if_prompt(), lambda c: cat(c.role, "\n", c.text, c.sep), _role("\n")),
    "LLAMA2": Style(
        lambda c: given(c.has_system, c.prompt, "[INST] "),
        lambda c: given(c.i == 0, cat(c.text, " "), cat(_tag(c), " ", c.text, c.sep_i)),
        _tag,
    ),
    "LLAMA3": Style(
        lambda c: given(c.has_system, c.prompt),
        lambda c: cat(_header(c), c.text, LLAMA3_END),
        _header,
    ),
    "CHATGLM": Style(
        _if_prompt(),
        lambda c: cat(_round(c), c.role, "：", c.text, c.sep),
        lambda c: cat(_round(c), c.role, "："),
    ),
    "CHATML": Style(_if_prompt("\n"), lambda c: cat(c.role, "\n", c.text, c.sep, "\n"), _role("\n"), images=True),
    "CHATINTERN": Style(
        _prompt,
        lambda c: cat(given(c.even, F.lit("<s>")), c.role, ":", c.text, c.sep_i, "\n"),
        lambda c: cat(given(c.even, F.lit("<s>")), c.role, ":"),
    ),
    "DOLLY": Style(
        _prompt,
        lambda c: cat(c.role, ":\n", c.text, c.sep_i, given(~c.even, F.lit("\n\n"))),
        _role(":\n"),
    ),
    "RWKV": Style(
        _prompt,
        lambda c: cat(c.role, ": ", F.replace(F.replace(c.text, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n")), "\n\n"),
        _role(":"),
    ),
    "PHOENIX": Style(_prompt, lambda c: cat(c.role, ": <s>", c.text, "</s>"), _role(": <s>")),
    "ROBIN": Style(_prompt_and_sep, lambda c: cat(c.role, ":\n", c.text, c.sep), _role(":\n")),
    "FALCON_CHAT": Style(
        lambda c: given(c.has_system, cat(c.prompt, c.sep)),
        lambda c: cat(c.role, ": ", c.text, c.sep),
        _role(":"),
    ),
    "CHATGLM3": Style(lambda c: given(c.has_system, c.prompt), lambda c: cat(c.role, "\n", c.text), _role()),
    "DEEPSEEK_CHAT": Style(_prompt, lambda c: cat(c.role, ": ", c.text, c.sep_i), _role(":")),
    "METAMATH": Style(
        _if_prompt(),
        lambda c: given(c.even, cat(c.role, ":\n", c.text, c.sep), cat(c.role, ": ", c.sep2, c.text)),
        lambda c: given(c.even, cat(c.role, ":\n"), cat(c.role, ": ", c.sep2)),
    ),
    "YUAN2": Style(
        lambda c: given(c.has_system, cat(c.prompt, c.sep2)),
        lambda c: cat(c.text, YUAN2_MARK),
        lambda c: F.lit(""),
    ),
    "GEMMA": Style(
        lambda c: F.lit(GEMMA_START),
        lambda c: cat(GEMMA_TURN, c.role, "\n", c.text, c.sep),
        lambda c: cat(GEMMA_TURN, c.role, "\n"),
    ),
    "CLLM": Style(_prompt_and_sep, lambda c: cat(c.role, ": ", c.text, c.sep_i), _role(":"), images=True),
    "DEFAULT": Style(lambda c: cat(c.prompt, "\n"), lambda c: cat(c.role, ": ", c.text, "\n"), _role(":")),
}


def with_image_marks(text: Column, images: Column) -> Column:
    """One marker per image in front of the text."""
    return F.concat(F.repeat(F.lit(IMAGE_MARK), F.size(F.coalesce(images, F.array().cast("array<string>")))), text)


def context(i: Column, role: Column, text: Column, images: Column | None = None) -> SimpleNamespace:
    """The names a style can use; the template's columns are expected beside the turn."""
    even = i % 2 == 0
    return SimpleNamespace(
        i=i, even=even, role=role, text=text, images=images, template=F.col("template"), roles=F.col("roles"),
        sep=F.col("sep"), sep2=F.col("sep2"), sep_i=given(even, F.col("sep"), F.col("sep2")),
    )


def piece(style: Style, c: SimpleNamespace) -> Column:
    """What a turn adds to the prompt; null and empty text both count as pending, unless the style shows images and there are some."""
    filled = F.coalesce(c.text, F.lit("")) != ""
    if style.images and c.images is not None:
        filled = filled | (F.coalesce(F.size(c.images), F.lit(0)) > 0)
        c = SimpleNamespace(**{**vars(c), "text": with_image_marks(F.coalesce(c.text, F.lit("")), c.images)})
    return F.when(filled, style.turn(c)).otherwise(style.pending(c))


def head(style: Style) -> Column:
    """The start of the prompt from ``system`` (already overridden) and the template's columns."""
    prompt = F.replace(F.col("wrap"), F.lit("{system_message}"), F.col("system"))
    return style.head(SimpleNamespace(
        prompt=prompt, has_system=F.col("system") != "", sep=F.col("sep"), sep2=F.col("sep2"), template=F.col("template")))


def finish(name: str, text: Column) -> Column:
    """The last step over the whole prompt, which only one style has."""
    if name != "YUAN2":
        return text
    return F.concat(F.regexp_replace(text, r"[<n>]+\z", ""), F.col("sep"))


def by_style(names: list[str], build: Callable[[str, Style], Column]) -> Column:
    """The build of the row's style among ``names``; another style is an error."""
    if len(names) == 1:
        return build(names[0], STYLES[names[0]])
    chosen = F.raise_error(F.concat(F.lit("no separator style "), F.coalesce(F.col("style"), F.lit("null")))).cast("string")
    for name in reversed(names):
        chosen = F.when(F.col("style") == name, build(name, STYLES[name])).otherwise(chosen)
    return chosen
