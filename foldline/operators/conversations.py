"""Conversations as turn tables: one row per turn, never one array per conversation.

``messages`` has ``conv_id, pos, role ('user' | 'assistant'), text`` and optionally ``images``; ``pos`` counts
from 0. ``heads`` has one row per conversation with ``conv_id, system`` (the lifted system text or null) and
``template``. Groupings and joins use (conv_id, pos) or blocks of it, so that one very long conversation is
spread over tasks; only the finished prompt, which is one value by definition, comes together in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let, prefix_sums, tokens
from ..functions.tokenisers import WHITESPACE, Tokeniser
from .ordering import assemble_text, positions
from .prompts import STYLES, by_style, context, finish, head, piece

# The separators by which a rendered prompt is cut into turns again for its labels.
LABEL_RULES = {
    "mistral": {"turn_sep": "</s>", "role_sep": " [/INST]", "bos": 1, "left": 0},
    "llama-2": {"turn_sep": " </s><s>", "role_sep": " [/INST]", "bos": 1, "left": -1},
    "llama-3": {
        "turn_sep": "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n",
        "role_sep": "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
        "bos": 1, "left": -4,
    },
}
IGNORED = -100
PLAIN = "no"  # fixed value: the name of the form without a template
CHAT_ROLES = ("user", "assistant")


def lift_system(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits a turn table into messages numbered from 0 and one head per conversation with its first system text."""
    kept = [c for c in turns.columns if c != "turn"]
    messages = positions(turns.where(F.col("role") != "system"), ["conv_id"], "turn").select(*kept, "pos")
    heads = turns.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "system", F.struct("turn", "text"))).alias("_s"))
    return messages, heads.select("conv_id", F.col("_s.text").alias("system"))


def alternation_violations(messages: DataFrame) -> DataFrame:
    """Turns whose role equals the role before, and roles outside user / assistant."""
    before = messages.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("role").alias("prev_role"))
    return messages.join(before, ["conv_id", "pos"], "left").where(
        (F.col("role") == F.col("prev_role")) | ~F.col("role").isin(*CHAT_ROLES))


def last_turn(messages: DataFrame) -> DataFrame:
    """Position and role of the last turn of each conversation, and its template where the turns carry one."""
    more = [F.max_by("template", "pos").alias("template")] if "template" in messages.columns else []
    return messages.groupBy("conv_id").agg(F.max("pos").alias("last_pos"), F.max_by("role", "pos").alias("last_role"), *more)


def generation_prompt(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Appends an assistant turn without text where the user spoke last; elsewhere it is not allowed."""
    last = last_turn(messages)
    allowed = last.where("last_role = 'user'")
    if strict:
        check = F.when(F.col("last_role") == "user", F.col("last_pos")).otherwise(
            F.raise_error(F.lit("a generation prompt can only follow a user turn")))
        allowed = last.withColumn("last_pos", check)
    waiting = allowed.select(
        "conv_id", (F.col("last_pos") + 1).alias("pos"), F.lit("assistant").alias("role"),
        F.lit(None).cast("string").alias("text"), *[c for c in allowed.columns if c == "template"])
    return messages.unionByName(waiting, allowMissingColumns=True)


def append_message(messages: DataFrame, added: DataFrame) -> DataFrame:
    """Adds one turn per conversation of ``added`` (conv_id, role, text) at its end."""
    ends = messages.groupBy("conv_id").agg((F.max("pos") + 1).alias("pos"))
    new = added.join(ends, "conv_id", "left").withColumn("pos", F.coalesce("pos", F.lit(0).cast("long")))
    return messages.unionByName(new.select("conv_id", "pos", "role", "text"), allowMissingColumns=True)


def update_last_message(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrites the text of the last turn where ``updates`` (conv_id, text) has one."""
    target = messages.groupBy("conv_id").agg(F.max("pos").alias("pos")).join(
        updates.select("conv_id", F.col("text").alias("_new")), "conv_id").withColumn("_hit", F.lit(True))
    return messages.join(target, ["conv_id", "pos"], "left").withColumn(
        "text", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("text"))).drop("_new", "_hit")


def set_system(heads: DataFrame, system: Column, only_missing: bool = False) -> DataFrame:
    return heads.withColumn("system", F.coalesce("system", system) if only_missing else system)


def last_two(messages: DataFrame, count: int = 2) -> DataFrame:
    """The last turns, numbered from 0 again: their positions are known, so that an equality join finds them."""
    wanted = messages.groupBy("conv_id").agg(F.max("pos").alias("_last")).select(
        "conv_id", F.posexplode(F.sequence(F.greatest(F.col("_last") - (count - 1), F.lit(0)), F.col("_last"))).alias("_i", "pos"))
    return messages.join(wanted, ["conv_id", "pos"]).withColumn("pos", F.col("_i").cast("long")).drop("_i")


def template_role(role: Column, roles: Column) -> Column:
    """The template's name of a role; another role than user and assistant is an error."""
    unknown = F.raise_error(F.concat(F.lit("no such role: "), F.coalesce(role, F.lit("null")))).cast("string")
    return F.when(role == "user", roles[0]).when(role == "assistant", roles[1]).otherwise(unknown)


def prompt_pieces(messages: DataFrame, templates: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """What every turn adds to its prompt, one row per turn: the form to use for further work at scale."""
    styles = styles or list(STYLES)
    if "CLLM" in styles and len(styles) > 1:
        raise ValueError("a style that shows the last turns only is rendered on its own")
    turns = last_two(messages) if styles == ["CLLM"] else messages
    dressed = turns.join(F.broadcast(templates), "template")  # at most one row per registered template
    role = template_role(F.col("role"), F.col("roles"))
    i = F.col("pos") + F.col("offset")
    c = context(i, role, F.col("text"), F.col("images") if "images" in turns.columns else None)
    return dressed.select("conv_id", "template", "pos", by_style(styles, lambda _, s: piece(s, c)).alias("piece"))


def prompt_heads(heads: DataFrame, templates: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """The start of every prompt: its system part and the template's example turns."""
    styles = styles or [s for s in STYLES if s != "CLLM"]
    dressed = heads.withColumnRenamed("system", "_own").join(F.broadcast(templates), "template").withColumn(
        "system", F.coalesce("_own", "system"))

    def examples(_, style):
        shown = F.transform(F.col("examples"), lambda m, i: piece(style, context(i, m["role"], m["text"])))
        return F.array_join(shown, "")

    return dressed.select("conv_id", "template", "style", "sep", by_style(styles, lambda _, s: head(s)).alias("head"),
                          by_style(styles, examples).alias("examples"))


def render(messages: DataFrame, heads: DataFrame, templates: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """One prompt per conversation. ``messages`` and ``heads`` both carry the template's name."""
    styles = styles or [s for s in STYLES if s != "CLLM"]
    bodies = assemble_text(prompt_pieces(messages, templates, styles), ["conv_id"], "pos", "piece", "body")
    starts = prompt_heads(heads, templates, styles)
    whole = F.concat("head", "examples", F.coalesce("body", F.lit("")))
    return starts.join(bodies, "conv_id", "left").select(
        "conv_id", "template", by_style(styles, lambda name, _: finish(name, whole)).alias("prompt"))


def checked(messages: DataFrame, violations: DataFrame, mode: str = "fail") -> DataFrame:
    """Leaves out conversations with a violation (``quarantine``) or raises when one exists (``fail``)."""
    if mode == "quarantine":
        return messages.join(violations.select("conv_id").distinct(), "conv_id", "left_anti")
    # a violation is found at its turn, so a long conversation stays spread out
    flagged = messages.join(violations.select("conv_id", "pos", F.lit(True).alias("_bad")), ["conv_id", "pos"], "left")
    return flagged.withColumn("role", F.when(F.col("_bad"), F.raise_error(
        F.concat(F.lit("two turns in a row have one role in conversation "), F.col("conv_id").cast("string")))
    ).otherwise(F.col("role"))).select(*messages.columns)


def supported(template: Column) -> Column:
    """The template, or an error if neither a label rule nor the plain form knows it."""
    return F.when(template.isin(PLAIN, *LABEL_RULES), template).otherwise(F.raise_error(
        F.concat(F.lit("no chat template for labels: "), F.coalesce(template, F.lit("null")))).cast("string"))


def apply_chat_template(messages: DataFrame, heads: DataFrame, templates: DataFrame, add_generation_prompt: bool = False,
                        mode: str = "fail") -> DataFrame:
    """Checks the turns, adds the generation prompt where asked and allowed, and renders.

    Conversations of the template ``no`` come as ``plain_template`` writes them, without a system text; more than two turns are
    an error there. A template that has no label rule is an error.
    """
    sound = checked(messages, alternation_violations(messages), mode).withColumn("template", supported(F.col("template")))
    plain, dressed = sound.where(F.col("template") == PLAIN), sound.where(F.col("template") != PLAIN)
    if add_generation_prompt:
        dressed = generation_prompt(dressed)
    rendered = render(dressed, heads.where(F.col("template") != PLAIN), templates, ["LLAMA2", "LLAMA3"])
    written = plain_template(plain)
    prompt = F.when(F.col("error").isNull(), F.col("raw")).otherwise(F.raise_error(F.col("error")).cast("string"))
    return rendered.unionByName(written.select("conv_id", F.lit(PLAIN).alias("template"), prompt.alias("prompt")))


def plain_template(messages: DataFrame, eos: str = "</s>") -> DataFrame:
    """User text, a space, assistant text and the end mark; more than two turns, or two of one role, are an error, put in ``error``.

    ``n_masked`` tokens at the front have label -100, the ``n_kept`` tokens of the assistant keep theirs. A conversation's first
    two turns are all that is gathered of it.
    """
    two = messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        *[F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"_{c}{i}") for i in (0, 1) for c in ("role", "text")])
    answer = F.concat(F.lit(" "), F.col("_text1"), F.lit(eos))
    error = F.when(F.col("n_turns") > 2, F.lit("multi-turn conversation needs a chat template")).when(
        F.col("_role0") == F.col("_role1"), F.lit("two turns in a row have one role"))
    fine = error.isNull()
    raw = F.when(fine, F.concat(F.col("_text0"), F.coalesce(answer, F.lit(""))))
    kept = F.when(fine, F.size(tokens(F.coalesce(answer, F.lit("")))))
    return two.select(
        "conv_id", "n_turns", raw.alias("raw"), error.alias("error"),
        (F.size(tokens(raw)) - kept).cast("long").alias("n_masked"), kept.cast("long").alias("n_kept"))


def plain_labels(plain: DataFrame, ids: Callable[[Column], Column]) -> DataFrame:
    """Tokens of what ``plain_template`` wrote, with their label: -100 for the user's, the token's id for the assistant's."""
    rows = plain.where("error is null").select("conv_id", "n_masked", F.posexplode(tokens(F.col("raw"))).alias("pos", "token"))
    masked = F.col("pos") < F.col("n_masked")
    return rows.select("conv_id", "pos", "token", F.when(masked, F.lit(IGNORED).cast("long")).otherwise(ids(F.col("token"))).alias("label"))


def _rule(name: str, of: Column) -> Column:
    return F.create_map(*[F.lit(x) for t, r in LABEL_RULES.items() for x in (t, r[name])])[of]


def masked_spans(prompt: Column, template: Column, tokeniser: Tokeniser = WHITESPACE) -> Column:
    """Token spans (start, stop) of a rendered prompt that carry no label, stop exclusive: an array, worked out inside the row.

    The prompt is cut at the turn separator. Up to the first turn that is empty or does not split into
    exactly two parts, the instruction part of every turn is masked; so is all that follows the last turn. Lengths are the tokeniser's.
    """
    def split_literal(text: Column, sep: Column) -> Column:
        return F.split(text, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1)

    turn_sep, role_sep, bos, left = (_rule(name, template) for name in ("turn_sep", "role_sep", "bos", "left"))
    turns = split_literal(prompt, turn_sep)
    heads = F.transform(turns, lambda t: F.concat(split_literal(t, role_sep)[0], role_sep))
    bad = F.transform(turns, lambda t: (t == "") | (F.size(split_literal(t, role_sep)) != 2))
    # all counts are taken at once before any of them is used, so that a tokeniser may be a function of whole batches
    n, counts = F.size(turns), tokeniser.counts(F.concat(F.array(turn_sep, prompt), turns, heads))
    zipped = F.arrays_zip(bad.alias("bad"), F.slice(counts, F.lit(3), n).alias("len"), F.slice(counts, n + 3, n).alias("instr"))
    row = F.struct(zipped.alias("turns"), F.get(counts, F.lit(0)).alias("sep"), (F.get(counts, F.lit(1)) + bos).alias("total"),
                   bos.alias("bos"), left.alias("left"))

    def spans(row: Column) -> Column:
        def span(start: Column, stop: Column) -> Column:
            return F.struct(F.greatest(start + row["left"], F.lit(0)).cast("long").alias("start"), stop.cast("long").alias("stop"))

        def measured(t: Column, i: Column) -> Column:
            first = F.when(i == 0, row["bos"]).otherwise(F.lit(0))
            return F.struct(t["bad"].alias("bad"), (t["len"] + first + row["sep"]).cast("long").alias("len"),
                            (t["instr"] + first).cast("long").alias("instr"))

        def until_bad(turns: Column) -> Column:
            at = F.array_position(F.transform(turns, lambda t: t["bad"]), True).cast("int")
            return F.slice(turns, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(turns)))

        def of_turns(good: Column) -> Column:
            def placed(ends: Column) -> Column:
                own = F.transform(good, lambda t, i: span(
                    F.get(ends, i) - t["len"], F.least(F.get(ends, i) - t["len"] + t["instr"], row["total"])))
                rest = span(F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)), row["total"])
                return F.filter(F.concat(own, F.array(rest)), lambda s: s["start"] < s["stop"])

            return let(prefix_sums(F.transform(good, lambda t: t["len"])), placed)

        return let(let(F.transform(row["turns"], measured), until_bad), of_turns)

    return let(row, spans)


def token_labels(prompts: DataFrame, ids: Callable[[Column], Column] | None = None, bos: str = "<s>", bos_id: int = 0,
                 tokeniser: Tokeniser = WHITESPACE) -> DataFrame:
    """Tokens of a rendered prompt with their label: the token's id, or -100 inside a masked span. Nothing leaves the prompt's row.

    ``ids`` gives a token's id in the vocabulary at hand; without it the tokeniser's own ids are taken.
    """
    prompt = F.col("prompt")
    read = tokeniser.encoded(prompt)
    own = F.lit(None).cast("array<long>") if ids else F.concat(F.array(F.lit(bos_id).cast("long")), read["ids"])
    rows = prompts.select("conv_id", F.concat(F.array(F.lit(bos)), read["pieces"]).alias("_words"), own.alias("_ids"),
                          masked_spans(prompt, F.col("template"), tokeniser).alias("_spans"))
    inside = F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"].cast("int"), s["stop"].cast("int") - 1)))
    every = F.sequence(F.lit(0), F.size("_words") - 1)
    masked = F.transform(F.array_intersect(every, inside), lambda i: F.struct(i.alias("pos"), F.lit(True).alias("masked")))
    open_ = F.transform(F.array_except(every, inside), lambda i: F.struct(i.alias("pos"), F.lit(False).alias("masked")))
    placed = rows.select("conv_id", "_words", "_ids", F.inline(F.concat(masked, open_))).select(
        "conv_id", "pos", "masked", F.get("_words", F.col("pos")).alias("token"), F.get("_ids", F.col("pos")).alias("id"))
    known = ids(F.col("token")) if ids else F.col("id")
    return placed.select("conv_id", "pos", "token", F.when(
        F.col("masked"), F.lit(IGNORED).cast("long")).otherwise(known).alias("label"))


def with_examples(messages: DataFrame, heads: DataFrame, templates: DataFrame) -> DataFrame:
    """The template's example turns in front of the conversation's own; ``exported`` tells them apart."""
    shown = heads.select("conv_id", "template").join(F.broadcast(templates), "template")
    examples = shown.select("conv_id", "template", F.posexplode("examples").alias("pos", "_m")).select(
        "conv_id", "template", F.col("pos").cast("long").alias("pos"),
        F.when(F.col("pos") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.col("_m.text").alias("text"), F.lit(False).alias("exported"))
    own = messages.join(F.broadcast(templates.select("template", "offset")), "template").select(
        "conv_id", "template", (F.col("pos") + F.col("offset")).alias("pos"), "role", "text", F.lit(True).alias("exported"))
    return examples.unionByName(own)


def role_messages(messages: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows (conv_id, idx, role, content): the system text first (idx -1) unless empty, then user and assistant
    by position; an assistant turn without text is left out."""
    system = heads.where(F.coalesce("system", F.lit("")) != "").select(
        "conv_id", F.lit(-1).cast("long").alias("idx"), F.lit("system").alias("role"), F.col("system").alias("content"))
    by_place = F.when(F.col("pos") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    spoken = messages.select("conv_id", F.col("pos").alias("idx"), by_place.alias("role"), F.col("text").alias("content"))
    return system.unionByName(spoken.where((F.col("role") == "user") | F.col("content").isNotNull()))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """[user, assistant] per pair of turns; a user turn without an answer keeps null."""
    return messages.groupBy("conv_id", F.expr("pos div 2").alias("pair")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.col("text"))).alias("user"),
        F.max(F.when(F.col("pos") % 2 == 1, F.col("text"))).alias("assistant"))


def image_refs(messages: DataFrame) -> DataFrame:
    """Images of the even turns, in order of turn and place."""
    return messages.where(F.col("pos") % 2 == 0).select("conv_id", "pos", F.posexplode("images").alias("place", "image"))


def extract_text(messages: DataFrame) -> DataFrame:
    """Role and text; the images stay behind."""
    return messages.select("conv_id", "pos", "role", F.col("msg.text").alias("text"))


def conversation_record(messages: DataFrame, heads: DataFrame, templates: DataFrame) -> DataFrame:
    """A JSON summary per conversation: template, system text, roles, all messages with role names, offset."""
    fields = F.broadcast(templates.select("template", "roles", "offset", F.size("examples").alias("_shown")))
    named = messages.join(fields, "template").withColumn("role", template_role(F.col("role"), F.col("roles")))
    lead = F.when(F.col("pos") + F.col("_shown") == 0, F.lit("")).otherwise(F.lit(","))
    pieces = named.withColumn("piece", F.concat(lead, F.to_json(F.array("role", "text"))))
    lists = assemble_text(pieces, ["conv_id"], "pos", "piece", "_messages")
    dressed = heads.withColumnRenamed("system", "_own").join(F.broadcast(templates), "template").withColumn(
        "system_message", F.coalesce("_own", "system"))
    start = F.to_json(F.struct(F.col("template").alias("template_name"), "system_message", "roles"))
    shown = F.array_join(F.transform("examples", lambda m: F.to_json(F.array(m["role"], m["text"]))), ",")
    return dressed.join(lists, "conv_id", "left").select("conv_id", F.concat(
        F.regexp_replace(start, r"\}$", ""), F.lit(',"messages":['), shown, F.coalesce("_messages", F.lit("")),
        F.lit('],"offset":'), F.col("offset").cast("string"), F.lit("}")).alias("record"))
