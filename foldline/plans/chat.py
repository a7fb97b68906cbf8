"""Queries over conversations and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import stable_hash
from ..operators import conversations as C
from ..operators.prompts import STYLES, with_image_marks
from .catalog import query
from .records import subwords
from .fixtures import CHAT_SQL, chats, sql_hash, sql_text, sql_tokens, table, with_images
from .templates import REGISTRY

# Head, turn and pending text per style in SQL. s: system prompt, sys: system text, r: role, m: text, i: place.
EVEN = "(i % 2 = 0)"
SEP_I = f"CASE WHEN {EVEN} THEN sep ELSE sep2 END"
TAG = f"CASE WHEN {EVEN} THEN r0 ELSE r1 END"
NL = "chr(10)"
ROUND = f"CASE WHEN {EVEN} THEN '[Round ' || (i // 2 + CASE WHEN template = 'chatglm2' THEN 1 ELSE 0 END) || ']' || sep ELSE '' END"
STYLE_SQL = {
    "ADD_COLON_SINGLE": ("s || sep", "r || ': ' || m || sep", "r || ':'"),
    "ADD_COLON_TWO": ("s || sep", f"r || ': ' || img || m || {SEP_I}", "r || ':'"),
    "ADD_COLON_SPACE_SINGLE": ("s || sep", "r || ': ' || m || sep", "r || ': '"),
    "NO_COLON_SINGLE": ("s", "r || m || sep", "r"),
    "NO_COLON_TWO": ("s", f"r || m || {SEP_I}", "r"),
    "ADD_NEW_LINE_SINGLE": ("CASE WHEN s = '' THEN '' ELSE s || sep END", f"r || {NL} || m || sep", f"r || {NL}"),
    "LLAMA2": ("CASE WHEN sys <> '' THEN s ELSE '[INST] ' END", f"CASE WHEN i = 0 THEN m || ' ' ELSE {TAG} || ' ' || m || {SEP_I} END", TAG),
    "LLAMA3": ("CASE WHEN sys <> '' THEN s ELSE '' END", f"'<|start_header_id|>' || r || '<|end_header_id|>' || {NL} || {NL} || m || '<|eot_id|>'",
               f"'<|start_header_id|>' || r || '<|end_header_id|>' || {NL} || {NL}"),
    "CHATGLM": ("CASE WHEN s = '' THEN '' ELSE s || sep END", f"{ROUND} || r || '：' || m || sep", f"{ROUND} || r || '：'"),
    "CHATML": (f"CASE WHEN s = '' THEN '' ELSE s || sep || {NL} END", f"r || {NL} || img || m || sep || {NL}", f"r || {NL}"),
    "CHATINTERN": ("s", f"CASE WHEN {EVEN} THEN '<s>' ELSE '' END || r || ':' || m || {SEP_I} || {NL}", f"CASE WHEN {EVEN} THEN '<s>' ELSE '' END || r || ':'"),
    "DOLLY": ("s", f"r || ':' || {NL} || m || {SEP_I} || CASE WHEN {EVEN} THEN '' ELSE {NL} || {NL} END", f"r || ':' || {NL}"),
    "RWKV": ("s", f"r || ': ' || replace(replace(m, chr(13) || {NL}, {NL}), {NL} || {NL}, {NL}) || {NL} || {NL}", "r || ':'"),
    "PHOENIX": ("s", "r || ': <s>' || m || '</s>'", "r || ': <s>'"),
    "ROBIN": ("s || sep", f"r || ':' || {NL} || m || sep", f"r || ':' || {NL}"),
    "FALCON_CHAT": ("CASE WHEN sys <> '' THEN s || sep ELSE '' END", "r || ': ' || m || sep", "r || ':'"),
    "CHATGLM3": ("CASE WHEN sys <> '' THEN s ELSE '' END", f"r || {NL} || m", "r"),
    "DEEPSEEK_CHAT": ("s", f"r || ': ' || m || {SEP_I}", "r || ':'"),
    "METAMATH": ("CASE WHEN s = '' THEN '' ELSE s || sep END",
                 f"CASE WHEN {EVEN} THEN r || ':' || {NL} || m || sep ELSE r || ': ' || sep2 || m END",
                 f"CASE WHEN {EVEN} THEN r || ':' || {NL} ELSE r || ': ' || sep2 END"),
    "YUAN2": ("CASE WHEN sys <> '' THEN s || sep2 ELSE '' END", "m || '<n>'", "''"),
    "GEMMA": ("'<bos>'", f"'<start_of_turn>' || r || {NL} || m || sep", f"'<start_of_turn>' || r || {NL}"),
    "CLLM": ("s || sep", f"r || ': ' || img || m || {SEP_I}", "r || ':'"),
    "DEFAULT": (f"s || {NL}", f"r || ': ' || m || {NL}", "r || ':'"),
}


def sql_null(text: str | None) -> str:
    return "NULL" if text is None else sql_text(text)


def sql_templates(names: list[str]) -> str:
    """The named templates as tpl, and their example turns as ex."""
    rows, shown = [], []
    for slot, name in enumerate(names):
        t = REGISTRY.get(name)
        rows.append(f"({slot}, {sql_text(name)}, {sql_null(t.style)}, {sql_text(t.roles[0])}, {sql_text(t.roles[1])}, {sql_null(t.sep)}, "
                    f"{sql_null(t.sep2)}, {sql_text(t.system)}, {sql_text(t.wrap)}, {t.offset})")
        shown += [f"({sql_text(name)}, {i}, {sql_text(r)}, {sql_text(m)})" for i, (r, m) in enumerate(t.examples)]
    shown = shown or ["('', 0, '', '')"]
    return f"""
tpl AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v(slot, template, style, r0, r1, sep, sep2, dsys, wrap, n_ex)),
ex AS (SELECT * FROM (VALUES {', '.join(shown)}) AS v(template, i, r, m))"""


def sql_render(names: list[str], styles: list[str], pending: bool = True, images: bool = False, last: int | None = None,
               where: str = "true") -> str:
    """rendered(conv_id, template, prompt) for conversations that take the named templates in turn."""
    def case(part: int) -> str:
        if len(styles) == 1:
            return STYLE_SQL[styles[0]][part]
        return "CASE style " + " ".join(f"WHEN '{s}' THEN ({STYLE_SQL[s][part]})" for s in styles) + " END"

    waiting = """
  UNION ALL SELECT conv_id, 'assistant', NULL, max(pos) + 1 FROM msgs GROUP BY conv_id HAVING max_by(role, pos) = 'user'""" if pending else ""
    cut = f"WHERE pos >= n - {last}" if last else ""
    place = f"pos - greatest(n - {last}, 0)" if last else "pos + n_ex"
    img = "repeat('$$<image>$$', CASE WHEN pos % 4 = 0 THEN 2 ELSE 0 END)" if images else "''"
    said = "CASE WHEN pos % 8 = 4 THEN '' ELSE coalesce(text, '') END" if images else "coalesce(text, '')"
    done = "rtrim(head || coalesce(body, ''), '<n>') || sep" if styles == ["YUAN2"] else "head || coalesce(body, '')"
    if "YUAN2" in styles and len(styles) > 1:
        done = f"CASE WHEN style = 'YUAN2' THEN rtrim(head || coalesce(body, ''), '<n>') || sep ELSE {done} END"
    return f"""{CHAT_SQL},{sql_templates(names)},
hd AS (
  SELECT h.conv_id, t.*, coalesce(h.system, t.dsys) AS sys, replace(t.wrap, '{{system_message}}', coalesce(h.system, t.dsys)) AS s
  FROM heads h JOIN tpl t ON t.slot = h.conv_id % {len(names)} WHERE {where}),
talk AS (SELECT conv_id, role, text, pos FROM msgs{waiting}),
counted AS (SELECT *, max(pos) OVER (PARTITION BY conv_id) + 1 AS n FROM talk),
turns AS (
  SELECT c.conv_id, {place} AS i, CASE role WHEN 'user' THEN r0 ELSE r1 END AS r, {said} AS m, {img} AS img,
         template, style, r0, r1, sep, sep2
  FROM counted c JOIN hd USING (conv_id) {cut}
  UNION ALL
  SELECT hd.conv_id, ex.i, ex.r, ex.m, '', hd.template, style, r0, r1, sep, sep2 FROM hd JOIN ex ON ex.template = hd.template),
bodies AS (SELECT conv_id, string_agg(CASE WHEN m <> '' OR img <> '' THEN {case(1)} ELSE {case(2)} END, '' ORDER BY i) AS body FROM turns GROUP BY conv_id),
rendered AS (SELECT conv_id, template, {done} AS prompt FROM (SELECT *, {case(0)} AS head FROM hd) LEFT JOIN bodies USING (conv_id))"""


def talk(spark, sf, names: list[str], pending: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages with a waiting assistant turn after a last user turn, heads and the named templates."""
    messages, heads = chats(spark, sf, names)
    return C.generation_prompt(messages) if pending else messages, heads, REGISTRY.frame(spark, names)


for _style in STYLES:
    _names = REGISTRY.names(_style)
    _sql = sql_render(_names, [_style], images=STYLES[_style].images, last=2 if _style == "CLLM" else None)

    @query(f"render_prompt_{_style.lower()}", f"WITH {_sql} SELECT conv_id, template, prompt FROM rendered")
    def _render(spark, sf, style=_style, names=_names):
        messages, heads, templates = talk(spark, sf, names)
        if STYLES[style].images:  # some turns have images alone
            messages = messages.withColumn("text", F.when(F.col("pos") % 8 == 4, F.lit("")).otherwise(F.col("text")))
        return C.render(with_images(messages), heads, templates, [style])


ALL_STYLES = [s for s in STYLES if s != "CLLM"]
ALL_NAMES = [n for n in REGISTRY.names() if REGISTRY.get(n).style in ALL_STYLES]


@query("template_registry", f"""WITH {sql_render(ALL_NAMES, ALL_STYLES)}
SELECT conv_id, r.template, t.style, t.n_ex::BIGINT AS offset_turns, md5(prompt) AS digest FROM rendered r JOIN tpl t USING (template)""")
def template_registry(spark, sf):
    """Every conversation with the next template of the registry."""
    messages, heads, templates = talk(spark, sf, ALL_NAMES)
    return C.render(messages, heads, templates, ALL_STYLES).join(F.broadcast(templates), "template").select(
        "conv_id", "template", "style", F.col("offset").cast("long").alias("offset_turns"), F.md5("prompt").alias("digest"))


CHAT_NAMES = list(C.LABEL_RULES)
CHAT_RENDER = sql_render(CHAT_NAMES, ["LLAMA2", "LLAMA3"])


@query("apply_chat_template", f"WITH {CHAT_RENDER} SELECT conv_id, template, prompt FROM rendered")
def apply_chat_template(spark, sf):
    messages, heads, templates = talk(spark, sf, CHAT_NAMES, pending=False)
    return C.apply_chat_template(messages, heads, templates, add_generation_prompt=True)


PLAIN_SQL = f"""{CHAT_SQL},
p AS (SELECT conv_id, max(text) FILTER (pos = 0) AS u, max(text) FILTER (pos = 1) AS a FROM msgs WHERE pos < 2 GROUP BY conv_id),
r AS (SELECT conv_id, u || coalesce(' ' || a || '</s>', '') AS raw, {sql_tokens("u || coalesce(' ' || a || '</s>', '')")} AS w,
      len({sql_tokens("coalesce(a || '</s>', '')")}) AS n_kept FROM p WHERE u IS NOT NULL)"""


def first_exchange(spark, sf):
    """The first two turns of every conversation: what the form without a template is for."""
    messages, heads = chats(spark, sf, [C.PLAIN])
    return messages.where("pos < 2"), heads


@query("apply_no_template", f"WITH {PLAIN_SQL} SELECT conv_id, 'no' AS template, raw AS prompt FROM r")
def apply_no_template(spark, sf):
    return C.apply_chat_template(*first_exchange(spark, sf), REGISTRY.frame(spark, CHAT_NAMES))


@query("plain_labels", f"""WITH {PLAIN_SQL}, t AS (SELECT conv_id, n_kept, len(w) AS n, unnest(range(len(w))) AS pos, unnest(w) AS token FROM r)
SELECT conv_id, pos, token, CASE WHEN pos < n - n_kept THEN -100 ELSE {sql_hash('token')} END::BIGINT AS label FROM t""")
def plain_labels(spark, sf):
    messages, _ = first_exchange(spark, sf)
    return C.plain_labels(C.plain_template(messages), stable_hash).withColumn("pos", F.col("pos").cast("long"))


@query("role_alternation", f"""WITH {CHAT_SQL}, folded AS (SELECT conv_id, pos, CASE WHEN pos % 5 = 3 THEN 'user' ELSE role END AS role FROM msgs)
SELECT conv_id, pos, role, prev_role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS prev_role FROM folded) WHERE role = prev_role""")
def role_alternation(spark, sf):
    """The test turns alternate, so every fifth is given the user's role first."""
    messages, _ = chats(spark, sf)
    folded = messages.withColumn("role", F.when(F.col("pos") % 5 == 3, F.lit("user")).otherwise(F.col("role")))
    return C.alternation_violations(folded).select("conv_id", "pos", "role", "prev_role")


@query("generation_prompt", f"""WITH {CHAT_SQL} SELECT conv_id, pos, role, text FROM msgs
UNION ALL SELECT conv_id, max(pos) + 1, 'assistant', NULL FROM msgs GROUP BY conv_id HAVING max_by(role, pos) = 'user'""")
def generation_prompt(spark, sf):
    return C.generation_prompt(chats(spark, sf)[0]).select("conv_id", "pos", "role", "text")


@query("plain_template", f"""WITH {CHAT_SQL}, p AS (
SELECT conv_id, count(*) AS n_turns, max(text) FILTER (pos = 0) AS u, max(text) FILTER (pos = 1) AS a FROM msgs GROUP BY conv_id),
r AS (SELECT conv_id, n_turns, CASE WHEN n_turns <= 2 THEN u || coalesce(' ' || a || '</s>', '') END AS raw, coalesce(' ' || a || '</s>', '') AS tail FROM p)
SELECT conv_id, n_turns, raw, CASE WHEN n_turns > 2 THEN 'multi-turn conversation needs a chat template' END AS error,
CASE WHEN n_turns <= 2 THEN len({sql_tokens('raw')}) - len({sql_tokens('tail')}) END AS n_masked,
CASE WHEN n_turns <= 2 THEN len({sql_tokens('tail')}) END AS n_kept FROM r""")
def plain_template(spark, sf):
    return C.plain_template(chats(spark, sf)[0])


LABEL_CTE = []
for _name, _rule in C.LABEL_RULES.items():
    LABEL_CTE.append(f"({sql_text(_name)}, {sql_text(_rule['turn_sep'])}, {sql_text(_rule['role_sep'])}, {_rule['bos']}, {_rule['left']})")
LABEL_SQL = CHAT_RENDER + f""",
rules AS (SELECT * FROM (VALUES {', '.join(LABEL_CTE)}) AS v(template, tsep, rsep, bos, lft)),
cut AS (
  SELECT conv_id, tsep, rsep, bos, lft, len({sql_tokens('prompt')}) + bos AS total, unnest(string_split(prompt, tsep)) AS turn,
         unnest(range(len(string_split(prompt, tsep)))) AS i
  FROM rendered JOIN rules USING (template)),
meas AS (
  SELECT *, CASE WHEN turn = '' OR len(string_split(turn, rsep)) <> 2 THEN 1 ELSE 0 END AS bad,
         len({sql_tokens('turn')}) + len({sql_tokens('tsep')}) + CASE WHEN i = 0 THEN bos ELSE 0 END AS adv,
         len({sql_tokens('string_split(turn, rsep)[1] || rsep')}) + CASE WHEN i = 0 THEN bos ELSE 0 END AS instr FROM cut),
run AS (
  SELECT *, sum(bad) OVER w AS bads, sum(adv) OVER w AS upto FROM meas WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
spans AS (
  SELECT conv_id, greatest(upto - adv + lft, 0)::BIGINT AS start, least(upto - adv + instr, total)::BIGINT AS stop FROM run WHERE bads = 0
  UNION ALL
  SELECT conv_id, greatest(coalesce(max(upto) FILTER (bads = 0), 0) + max(lft), 0)::BIGINT, max(total)::BIGINT FROM run GROUP BY conv_id),
toks AS (SELECT conv_id, list_concat(['<s>'], {sql_tokens('prompt')}) AS w FROM rendered),
rows AS (SELECT conv_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM toks)"""


@query("turn_label_spans", f"""WITH {LABEL_SQL}
SELECT r.conv_id, r.pos, CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.conv_id = r.conv_id AND r.pos >= s.start AND r.pos < s.stop)
THEN -100 ELSE {sql_hash('r.token')} END::BIGINT AS label FROM rows r""")
def turn_label_spans(spark, sf):
    messages, heads, templates = talk(spark, sf, CHAT_NAMES)
    labels = C.token_labels(C.render(messages, heads, templates, ["LLAMA2", "LLAMA3"]), stable_hash)
    return labels.select("conv_id", F.col("pos").cast("long").alias("pos"), "label")


@query("label_spans_subwords")
def label_spans_subwords(spark, sf):
    """The same labels by a subword vocabulary, whose counts the left offsets are made for."""
    messages, heads, templates = talk(spark, sf, CHAT_NAMES)
    labels = C.token_labels(C.render(messages, heads, templates, ["LLAMA2", "LLAMA3"]), tokeniser=subwords(spark))
    return labels.select("conv_id", F.col("pos").cast("long").alias("pos"), "token", "label")


VICUNA = REGISTRY.get("vicuna_v1.1").system


@query("to_role_messages", f"""WITH {CHAT_SQL}, g AS (SELECT conv_id, pos, text FROM msgs
UNION ALL SELECT conv_id, max(pos) + 1, NULL FROM msgs GROUP BY conv_id HAVING max_by(role, pos) = 'user')
SELECT conv_id, -1::BIGINT AS idx, 'system' AS role, coalesce(system, {sql_text(VICUNA)}) AS content FROM heads
UNION ALL SELECT conv_id, pos, CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END, text FROM g WHERE pos % 2 = 0 OR text IS NOT NULL""")
def to_role_messages(spark, sf):
    messages, heads = chats(spark, sf)
    return C.role_messages(C.generation_prompt(messages), C.set_system(heads, F.lit(VICUNA), only_missing=True))


@query("turn_pairs", f"""WITH {CHAT_SQL} SELECT conv_id, pos // 2 AS pair, max(text) FILTER (pos % 2 = 0) AS "user",
max(text) FILTER (pos % 2 = 1) AS assistant FROM msgs GROUP BY ALL""")
def turn_pairs(spark, sf):
    return C.turn_pairs(chats(spark, sf)[0])


@query("extract_text", "SELECT conv_id, turn AS pos, role, text FROM conversations")
def extract_text(spark, sf):
    """Over the turns as they are: a projection."""
    turns = with_images(table(spark, sf, "conversations").withColumnRenamed("turn", "pos"))
    return C.extract_text(turns.withColumn("msg", F.struct("text", "images")).drop("text"))


@query("image_refs", f"""WITH {CHAT_SQL}, m AS (SELECT conv_id, pos, ['img-' || conv_id, 'img-' || pos] AS images FROM msgs WHERE pos % 4 = 0)
SELECT conv_id, pos, unnest([0, 1])::BIGINT AS place, unnest(images) AS image FROM m""")
def image_refs(spark, sf):
    refs = C.image_refs(with_images(chats(spark, sf)[0]))
    return refs.withColumn("place", F.col("place").cast("long"))


@query("image_placeholder", f"""WITH {CHAT_SQL} SELECT conv_id, pos, CASE WHEN pos % 4 = 0 THEN '$$<image>$$$$<image>$$' ELSE '' END || text AS text FROM msgs""")
def image_placeholder(spark, sf):
    return with_images(chats(spark, sf)[0]).select("conv_id", "pos", with_image_marks(F.col("text"), F.col("images")).alias("text"))


SHOT_NAMES = [n for n in REGISTRY.names() if REGISTRY.get(n).examples]


@query("skip_fewshot", f"""WITH {CHAT_SQL},{sql_templates(SHOT_NAMES)},
h AS (SELECT conv_id, t.template, n_ex FROM heads JOIN tpl t ON t.slot = conv_id % {len(SHOT_NAMES)})
SELECT conv_id, template, ex.i::BIGINT AS pos, CASE WHEN ex.i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, ex.m AS text, false AS exported
FROM h JOIN ex USING (template)
UNION ALL SELECT conv_id, template, pos + n_ex, role, text, true FROM msgs JOIN h USING (conv_id)""")
def skip_fewshot(spark, sf):
    """``exported`` is false for the example turns, which only rendering shows."""
    messages, heads, templates = talk(spark, sf, SHOT_NAMES, pending=False)
    return C.with_examples(messages, heads, templates)


@query("edit_turns", f"""WITH {CHAT_SQL}, e AS (SELECT conv_id, max(pos) AS last, max_by(role, pos) AS role FROM msgs GROUP BY conv_id),
u AS (SELECT m.conv_id, m.pos, m.role, CASE WHEN m.pos = e.last AND e.role = 'user' THEN 'Never mind.' ELSE m.text END AS text FROM msgs m JOIN e USING (conv_id)
UNION ALL SELECT conv_id, last + 1, 'user', 'Please continue.' FROM e WHERE role = 'assistant')
SELECT conv_id, pos, u.role, text, coalesce(system, 'Be brief.') AS system FROM u JOIN heads USING (conv_id)""")
def edit_turns(spark, sf):
    """A last user turn is overwritten, a last assistant turn answered, a missing system text set."""
    messages, heads = chats(spark, sf)
    last = C.last_turn(messages)
    added = last.where("last_role = 'assistant'").select("conv_id", F.lit("user").alias("role"), F.lit("Please continue.").alias("text"))
    changed = last.where("last_role = 'user'").select("conv_id", F.lit("Never mind.").alias("text"))
    edited = C.append_message(C.update_last_message(messages, changed), added)
    return edited.join(C.set_system(heads, F.lit("Be brief."), only_missing=True), "conv_id").select(
        "conv_id", "pos", "role", "text", "system")


RECORD_NAMES = ["vicuna_v1.1", "chatgpt", "baize"]


@query("conversation_record", f"""WITH {CHAT_SQL},{sql_templates(RECORD_NAMES)},
h AS (SELECT conv_id, t.*, coalesce(system, dsys) AS sys FROM heads JOIN tpl t ON t.slot = conv_id % {len(RECORD_NAMES)}),
a AS (
  SELECT conv_id, pos + n_ex AS i, CASE role WHEN 'user' THEN r0 ELSE r1 END AS r, text AS m FROM msgs JOIN h USING (conv_id)
  UNION ALL SELECT conv_id, ex.i, ex.r, ex.m FROM h JOIN ex USING (template)),
m AS (SELECT conv_id, string_agg(to_json([r, m])::VARCHAR, ',' ORDER BY i) AS list FROM a GROUP BY conv_id)
SELECT conv_id, '{{"template_name":' || to_json(template)::VARCHAR || ',"system_message":' || to_json(sys)::VARCHAR || ',"roles":'
|| to_json([r0, r1])::VARCHAR || ',"messages":[' || coalesce(list, '') || '],"offset":' || n_ex || '}}' AS record
FROM h LEFT JOIN m USING (conv_id)""")
def conversation_record(spark, sf):
    messages, heads, templates = talk(spark, sf, RECORD_NAMES, pending=False)
    return C.conversation_record(messages, heads, templates)


@query("last_two_turns", f"""WITH {CHAT_SQL}, n AS (SELECT *, max(pos) OVER (PARTITION BY conv_id) + 1 AS n FROM msgs)
SELECT conv_id, pos - greatest(n - 2, 0) AS pos, role, text FROM n WHERE pos >= n - 2""")
def last_two_turns(spark, sf):
    return C.last_two(chats(spark, sf)[0]).select("conv_id", "pos", "role", "text")
