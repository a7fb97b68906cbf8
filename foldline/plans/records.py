"""Queries over sources, text assembly and segments."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions.text import first_tokens, stable_hash, tokens
from ..functions.tokenisers import Subwords
from ..operators import assembly as A, segments as G
from ..session import new_folder, stored
from ..sources import jsonl as S
from .catalog import query
from .fixtures import (BUNDLE_SQL, PREDICTION_SQL, QA_SQL, SEGMENT, bundles, predictions, qa, sql_draw, sql_hash, sql_text,
                       sql_tokens, table)

ID = {"example_id": T.LongType()}


def ids(words):
    return F.transform(words, lambda w: stable_hash(w))


def digest(array):
    return F.md5(F.array_join(array.cast("array<string>"), ","))


def sql_ids(words: str) -> str:
    return f"list_transform({words}, lambda w: {sql_hash('w')})"


def sql_digest(array: str) -> str:
    return f"md5(coalesce(array_to_string({array}, ','), ''))"


def raw_qa(spark, sf):
    return qa(spark, sf).select("example_id", F.col("question").alias("prompt"), F.col("answers").alias("answer"),
                                F.col("document").alias("input"))


def written_raw_qa(spark, sf):
    """The raw records as a JSON-lines file with a blank line after each."""
    path = new_folder(spark, "raw-qa")
    line = F.to_json(F.struct("example_id", "prompt", "answer", "input"))
    raw_qa(spark, sf).select(F.explode(F.array(line, F.lit("   "))).alias("value")).write.text(path)
    return path


def flat_record(df):
    ctx = F.col("ctxs")[0]
    return df.select("example_id", "question", F.array_join("answers", "|").alias("answers"), ctx["isgold"].alias("isgold"),
                     ctx["text"].alias("text"), ctx["title"].alias("title"), F.size("ctxs").cast("long").alias("n_ctxs"))


RECORD_SQL = f"""WITH {QA_SQL}
SELECT example_id, question, array_to_string(answers, '|') AS answers, false AS isgold, document AS text, '' AS title,
       1::BIGINT AS n_ctxs FROM qa"""


@query("read_qa_jsonl", f"WITH {QA_SQL} SELECT example_id, question AS prompt, array_to_string(answers, '|') AS answer, document AS input FROM qa")
def read_qa_jsonl(spark, sf):
    return S.read_raw_qa(spark, written_raw_qa(spark, sf), **ID).select(
        "example_id", "prompt", F.array_join("answer", "|").alias("answer"), "input")


@query("to_qa_record", RECORD_SQL)
def to_qa_record(spark, sf):
    return flat_record(S.to_qa_record(raw_qa(spark, sf)))


@query("write_qa_jsonl", RECORD_SQL)
def write_qa_jsonl(spark, sf):
    path = new_folder(spark, "qa")
    S.write_json_lines(S.to_qa_record(raw_qa(spark, sf)), path)
    return flat_record(S.read_qa_records(spark, path, **ID))


@query("read_qa_records", f"""WITH {QA_SQL} SELECT example_id, md5(question) AS question, md5(document) AS text, '' AS title,
array_to_string(answers, '|') AS answers FROM qa""")
def read_qa_records(spark, sf):
    path = new_folder(spark, "qa")
    S.write_json_lines(S.to_qa_record(S.read_raw_qa(spark, written_raw_qa(spark, sf), **ID)), path)
    ctx = F.col("ctxs")[0]
    return S.read_qa_records(spark, path, **ID).select(
        "example_id", F.md5("question").alias("question"), F.md5(ctx["text"]).alias("text"), ctx["title"].alias("title"),
        F.array_join("answers", "|").alias("answers"))


@query("append_jsonl", f"WITH {PREDICTION_SQL} SELECT example_id, generation FROM predictions")
def append_jsonl(spark, sf):
    """Two batches to one log, one of them appended again, give all rows once."""
    path, said = new_folder(spark, "log"), predictions(qa(spark, sf))
    S.append_json_lines(said.where("example_id % 2 = 0"), path, batch=0)
    for _ in range(2):
        S.append_json_lines(said.where("example_id % 2 = 1"), path, batch=1)
    return S.read_log(spark, path, T.StructType([T.StructField("example_id", T.LongType()), T.StructField("generation", T.StringType())]))


@query("append_text", f"WITH {QA_SQL} SELECT value, count(*) AS n FROM (SELECT question AS value FROM qa UNION ALL SELECT dataset FROM qa) GROUP BY value")
def append_text(spark, sf):
    path, rows = new_folder(spark, "lines"), qa(spark, sf)
    S.append_text(rows.select("question"), path, batch="questions")
    for _ in range(2):
        S.append_text(rows.select("dataset"), path, batch="names")
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_from_path", """SELECT doc_id, split_part(split_part(path, '-', -1), '.', 1) AS dataset
FROM (SELECT doc_id, '/data/run-' || doc_id || '/test-' || upper(lang) || '.v1.jsonl' AS path FROM documents)""")
def dataset_from_path(spark, sf):
    path = F.concat(F.lit("/data/run-"), "doc_id", F.lit("/test-"), F.upper("lang"), F.lit(".v1.jsonl"))
    return table(spark, sf, "documents").select("doc_id", S.dataset_from_path(path).alias("dataset"))


@query("format_document", f"WITH {BUNDLE_SQL} SELECT example_id, ord, formatted, array_to_string({sql_tokens('formatted')}[1:32], ' ') AS cut FROM ctx")
def format_document(spark, sf):
    docs = bundles(spark, sf).withColumn("_d", F.arrays_zip(
        A.documents(F.col("ctxs")).alias("formatted"), A.documents(F.col("ctxs"), 32).alias("cut")))
    return docs.select("example_id", F.posexplode("_d").alias("ord", "_d")).select(
        "example_id", F.col("ord").cast("long").alias("ord"), "_d.formatted", "_d.cut")


@query("trunc_text", f"SELECT doc_id, array_to_string({sql_tokens('text')}[1:20], ' ') AS first20, text AS whole FROM documents")
def trunc_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", first_tokens(F.col("text"), 20).alias("first20"), first_tokens(F.col("text"), None).alias("whole"))


JOIN_SQL = f"""{BUNDLE_SQL},
docs AS (SELECT example_id, list(formatted ORDER BY ord) AS d FROM ctx GROUP BY example_id)"""


@query("join_documents", f"""WITH {JOIN_SQL} SELECT example_id, array_to_string(d, chr(10)) AS whole,
array_to_string({sql_tokens('array_to_string(d[1:3], chr(10))')}[1:100], ' ') AS train FROM docs""")
def join_documents(spark, sf):
    docs = A.documents(F.col("ctxs"))
    return bundles(spark, sf).select("example_id", A.joined_documents(docs).alias("whole"),
                                     A.joined_documents(docs, 3, 100).alias("train"))


@query("random_doc_cap", f"""WITH {JOIN_SQL}, b AS (SELECT example_id, d, 2 + {sql_draw('example_id // 4', 42, 4)} AS cap FROM docs)
SELECT example_id, cap, md5(array_to_string(d[1:cap], chr(10))) AS digest FROM b""")
def random_doc_cap(spark, sf):
    capped = bundles(spark, sf).withColumn("cap", A.drawn_cap(F.expr("example_id div 4"), 2, 5, 42))
    return capped.select("example_id", "cap", F.md5(A.joined_documents(A.documents(F.col("ctxs")), F.col("cap").cast("int"))).alias("digest"))


NAMES = list(A.INSTRUCTIONS)


@query("instruction_lookup", f"""SELECT doc_id, n AS name, t AS instruction FROM documents JOIN (VALUES
{', '.join(f'({i}, {sql_text(n)}, {sql_text(t)})' for i, (n, t) in enumerate(A.INSTRUCTIONS.items()))}) AS v(i, n, t) ON i = doc_id % {len(NAMES)}""")
def instruction_lookup(spark, sf):
    name = F.array(*[F.lit(n) for n in NAMES])[F.pmod("doc_id", F.lit(len(NAMES))).cast("int")]
    return table(spark, sf, "documents").select("doc_id", name.alias("name")).withColumn(
        "instruction", A.lookup(A.INSTRUCTIONS, F.col("name"), True, "instruction"))


@query("question_prompt", f"""WITH {QA_SQL} SELECT example_id, 'Question:' || question || chr(10) || 'Answer:' AS infer,
chr(10) || 'Question:' || question || chr(10) || 'Answer:' AS train FROM qa""")
def question_prompt(spark, sf):
    return qa(spark, sf).select("example_id", A.question_prompt(F.col("question")).alias("infer"),
                                A.question_prompt(F.col("question"), True).alias("train"))


@query("restatement_pairs", f"""WITH {JOIN_SQL}, c AS (
SELECT example_id, array_to_string({sql_tokens('array_to_string(d[1:4], chr(10))')}[1:200], ' ') AS context FROM docs)
SELECT example_id, context, 'Restate the aforementioned Text.' AS instruction, context AS target FROM c""")
def restatement_pairs(spark, sf):
    docs = bundles(spark, sf).select("example_id", A.documents(F.col("ctxs")).alias("docs"))
    return A.restatement_pairs(docs, "docs", 4, 200).select("example_id", "context", "instruction", "target")


def subwords(spark) -> Subwords:
    """The codec of a public vocabulary file."""
    import public_tokenizers

    return Subwords(spark, public_tokenizers.path("byte_bpe_50k.json"))


@query("tokenize_subwords")
def tokenize_subwords(spark, sf):
    """Ids, pieces and offsets of all documents by a subword vocabulary."""
    codec, text = subwords(spark), F.coalesce("text", F.lit(""))
    rows = table(spark, sf, "documents").select("doc_id", codec.encoded(text).alias("_e"))
    # zipped where it is exploded: a column that is exploded as such gets a filter on its size, for which texts would be encoded again
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(
        F.col("_e.ids").alias("id"), F.col("_e.pieces").alias("piece"), F.col("_e.offsets").alias("place"))).alias("pos", "_t"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "_t.id", "_t.piece", "_t.place.start", "_t.place.stop")


@query("subword_round_trip", "SELECT doc_id, true AS same FROM documents")
def subword_round_trip(spark, sf):
    """Every document's ids decode to its text."""
    codec, text = subwords(spark), F.coalesce("text", F.lit(""))
    rows = table(spark, sf, "documents").select("doc_id", text.alias("text"), codec.ids(text).alias("ids"))
    return rows.select("doc_id", (codec.text(F.col("ids")) == F.col("text")).alias("same"))


@query("trunc_subwords")
def trunc_subwords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", first_tokens(F.coalesce("text", F.lit("")), 20, subwords(spark)).alias("first20"))


@query("segments_subwords")
def segments_subwords(spark, sf):
    """Questions and documents in segments of 50 subwords."""
    rows = G.segment_rows(qa(spark, sf), "example_id", "question", "document", SEGMENT, tokeniser=subwords(spark))
    return rows.select("example_id", "seg_idx", F.size("words").cast("long").alias("n_tokens"), F.array_join("words", "").alias("text"))


@query("tokenize", f"""SELECT doc_id, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS token
FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)""")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).withColumn(
        "pos", F.col("pos").cast("long"))


@query("token_ids", f"""WITH t AS (SELECT doc_id, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS token
FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)),
v AS (SELECT token, row_number() OVER (ORDER BY md5(token), token) - 1 AS token_id FROM (SELECT DISTINCT token FROM t))
SELECT doc_id, pos, token_id FROM t JOIN v USING (token)""")
def token_ids(spark, sf):
    """The vocabulary is stored: choosing its hot words and joining it both read it."""
    docs = table(spark, sf, "documents")
    return A.encode(docs, "doc_id", "text", stored(A.vocabulary(docs, "text"), "vocabulary")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "token_id")


PAD_SQL = f"""WITH t AS (SELECT doc_id, doc_id // 4 AS batch, {sql_ids(sql_tokens('text'))} AS a FROM documents),
p AS (SELECT *, max(len(a)) OVER (PARTITION BY batch) AS width FROM t),
q AS (SELECT doc_id, width, a, list_transform(range(width - len(a)), lambda x: 0::BIGINT) AS z,
             list_transform(a, lambda x: 1::BIGINT) AS ones FROM p)
SELECT doc_id, width, {{padded}} AS ids, {{mask}} AS mask FROM q"""


def padded(spark, sf, side):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.expr("doc_id div 4").alias("batch"), ids(tokens(F.col("text"))).alias("ids"),
        F.size(tokens(F.col("text"))).alias("n"))
    return A.pad_batches(docs, "ids", "batch", side, length=F.col("n")).select(
        "doc_id", F.size("padded").cast("long").alias("width"), digest(F.col("padded")).alias("ids"), digest(F.col("mask")).alias("mask"))


@query("pad_left", PAD_SQL.format(padded=sql_digest("list_concat(z, a)"), mask=sql_digest("list_concat(z, ones)")))
def pad_left(spark, sf):
    return padded(spark, sf, "left")


@query("pad_right", PAD_SQL.format(padded=sql_digest("list_concat(a, z)"), mask=sql_digest("list_concat(ones, z)")))
def pad_right(spark, sf):
    return padded(spark, sf, "right")


@query("pad_global", f"""WITH t AS (SELECT item_id, {sql_ids(sql_tokens('text'))} AS a FROM benchmark),
q AS (SELECT *, list_transform(range((SELECT max(len(a)) FROM t) - len(a)), lambda x: 0::BIGINT) AS z FROM t)
SELECT item_id, array_to_string(list_concat(a, z), ',') AS ids,
array_to_string(list_concat(list_transform(a, lambda x: 1::BIGINT), z), ',') AS mask FROM q""")
def pad_global(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", ids(tokens(F.col("text"))).alias("ids"))
    return A.pad_global(rows, "ids").select(
        "item_id", F.array_join(F.col("padded").cast("array<string>"), ",").alias("ids"),
        F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"))


INSTRUCTION_VALUES = ", ".join(f"({i}, {sql_text(t)})" for i, t in enumerate(A.INSTRUCTIONS.values()))
SEQ_SQL = f"""{QA_SQL}, parts AS (
SELECT example_id, {sql_ids(sql_tokens('t'))} AS ins, list_transform(range(4), lambda s: 900000000 + s) AS mem,
{sql_ids(sql_tokens("'Question:' || question || chr(10) || 'Answer:'"))} AS que,
{sql_ids(sql_tokens('answers[1 + example_id % 2]'))} AS ans
FROM qa JOIN (VALUES {INSTRUCTION_VALUES}) AS v(i, t) ON i = example_id % {len(NAMES)}),
padded AS (SELECT *, example_id // 4 AS batch, max(len(ans)) OVER (PARTITION BY example_id // 4) AS width FROM parts)"""


def sequences(spark, sf):
    rows = qa(spark, sf)
    instruction = F.array(*[F.lit(t) for t in A.INSTRUCTIONS.values()])[F.pmod("example_id", F.lit(len(NAMES))).cast("int")]
    answer = F.col("answers")[(F.col("example_id") % 2).cast("int")]
    return rows.select(
        "example_id", F.expr("example_id div 4").alias("batch"), ids(tokens(instruction)).alias("ins"),
        F.sequence(F.lit(900000000).cast("long"), F.lit(900000003).cast("long")).alias("mem"),
        ids(tokens(A.question_prompt(F.col("question")))).alias("que"), ids(tokens(answer)).alias("ans"))


def comma(array):
    return F.array_join(array.cast("array<string>"), ",")


@query("assemble_sequence", f"""WITH {SEQ_SQL}, s AS (SELECT example_id, list_concat(list_concat(ins, mem), list_concat(que, ans)) AS a FROM parts)
SELECT example_id, array_to_string(a, ',') AS ids, array_to_string(list_transform(a, lambda x: 1), ',') AS mask FROM s""")
def assemble_sequence(spark, sf):
    rows = sequences(spark, sf).select("example_id", A.assemble_ids(*[F.col(c) for c in ("ins", "mem", "que", "ans")]).alias("ids"))
    return rows.select("example_id", comma(F.col("ids")).alias("ids"), comma(F.transform("ids", lambda x: F.lit(1))).alias("mask"))


@query("label_mask", f"""WITH {SEQ_SQL} SELECT example_id, array_to_string(list_concat(list_concat(
list_transform(range(len(ins) + len(mem) + len(que)), lambda x: -100::BIGINT), ans),
list_transform(range(width - len(ans)), lambda x: -100::BIGINT)), ',') AS labels FROM padded""")
def label_mask(spark, sf):
    rows = A.pad_batches(sequences(spark, sf), "ans", "batch", "right")
    total = F.size("ins") + F.size("mem") + F.size("que") + F.size("padded")
    return rows.select("example_id", comma(A.label_ids(total, F.col("padded"), F.col("mask"))).alias("labels"))


@query("next_token_pairs", f"""WITH {SEQ_SQL}, s AS (
SELECT example_id, list_concat(list_concat(ins, mem), list_concat(que, ans)) AS a,
list_concat(list_transform(range(len(ins) + len(mem) + len(que)), lambda x: -100::BIGINT), ans) AS l FROM parts),
r AS (SELECT example_id, unnest(generate_series(0, len(a) - 2)) AS pos, unnest(a[1:len(a) - 1]) AS id, unnest(l[2:len(l)]) AS label FROM s)
SELECT example_id, pos, id, label FROM r""")
def next_token_pairs(spark, sf):
    rows = sequences(spark, sf).withColumn("ids", A.assemble_ids(*[F.col(c) for c in ("ins", "mem", "que", "ans")]))
    labels = A.label_ids(F.size("ids"), F.col("ans"), F.transform("ans", lambda x: F.lit(1)))
    pairs = rows.select("example_id", F.inline(A.next_token_pairs(F.col("ids"), labels)))
    return pairs.withColumn("pos", F.col("pos").cast("long"))


LANG_SIZES = {"en": 8, "fr": 4, "de": 2, "es": 1}


@query("batch_assign", """SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)
// CASE lang WHEN 'en' THEN 8 WHEN 'fr' THEN 4 WHEN 'de' THEN 2 ELSE 1 END AS batch_id FROM documents""")
def batch_assign(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return A.assign_batches(docs, "lang", "doc_id", A.lookup(LANG_SIZES, F.col("lang"), True, "data set"))


@query("gather_positions", f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)
SELECT doc_id, w[1] || ' ' || w[len(w)] || ' ' || w[len(w) // 2 + 1] AS picked FROM t""")
def gather_positions(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    wanted = F.array(F.lit(0), F.size("w") - 1, F.expr("cast(size(w) div 2 as int)"))
    return words.select("doc_id", F.array_join(A.gather(F.col("w"), wanted), " ").alias("picked"))


@query("random_choice", f"""SELECT doc_id, [2, 4, 8, 16, 32][1 + {sql_draw('doc_id', 42, 5)}]::BIGINT AS merge_size,
[64, 128][1 + {sql_draw('doc_id', 43, 2)}]::BIGINT AS slots FROM documents""")
def random_choice(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", A.drawn_choice(F.col("doc_id"), "2,4,8,16,32", 42).cast("long").alias("merge_size"),
        A.drawn_choice(F.col("doc_id"), [64, 128], 43).cast("long").alias("slots"))


@query("mask_nested", """SELECT doc_id, concat_ws(',', if(quality = 1, -100, quality), if(toxic = 1, -100, toxic),
if(toxic = 1, -100, toxic), if(quality = 1, -100, quality)) AS leaves FROM labels""")
def mask_nested(spark, sf):
    nested = F.array(F.array("quality", "toxic"), F.array("toxic", "quality"))
    return table(spark, sf, "labels").select("doc_id", comma(F.flatten(A.replace_nested(nested, 1, -100, 2))).alias("leaves"))


CAPS = list(A.MAX_NEW_TOKENS)
CAP_VALUES = ", ".join(f"({i}, {sql_text(n)}, {c})" for i, (n, c) in enumerate(A.MAX_NEW_TOKENS.items()))


@query("generation_cap", f"""WITH t AS (SELECT doc_id, n, c, {sql_tokens('text')} AS w FROM documents
JOIN (VALUES {CAP_VALUES}) AS v(i, n, c) ON i = doc_id % {len(CAPS)})
SELECT doc_id, n AS dataset, len(w[1:c])::BIGINT AS n_tokens, md5(array_to_string(w[1:c], ' ')) AS digest FROM t""")
def generation_cap(spark, sf):
    name = F.array(*[F.lit(n) for n in CAPS])[F.pmod("doc_id", F.lit(len(CAPS))).cast("int")]
    rows = table(spark, sf, "documents").select("doc_id", name.alias("dataset"), tokens(F.col("text")).alias("w"))
    cut = rows.withColumn("w", A.generation_cap(F.col("w"), F.col("dataset")))
    return cut.select("doc_id", "dataset", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


SEG_SQL = f"""t AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range((len(w) + {SEGMENT} - 1) // {SEGMENT})) AS seg_idx, (len(w) + {SEGMENT} - 1) // {SEGMENT} AS n FROM t)"""


@query("split_segments", f"""WITH {SEG_SQL} SELECT doc_id, seg_idx, len(w[seg_idx * {SEGMENT} + 1:seg_idx * {SEGMENT} + {SEGMENT}])::BIGINT AS seg_len,
md5(array_to_string(w[seg_idx * {SEGMENT} + 1:seg_idx * {SEGMENT} + {SEGMENT}], ' ')) AS digest FROM s""")
def split_segments(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return G.split_segments(words, "w", SEGMENT).select(
        "doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("seg_len").cast("long").alias("seg_len"),
        F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("segment_count", f"""WITH t AS (SELECT doc_id, len({sql_tokens('text')}) AS n FROM documents)
SELECT doc_id, (n + 49) // 50 AS by50, (n + 6) // 7 AS by7, (n + 999) // 1000 AS by1000 FROM t""")
def segment_count(spark, sf):
    """A document without tokens, as a larger corpus has it, has no segment, and one without a text no count."""
    length = table(spark, sf, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n"))
    return length.select("doc_id", *[G.segment_count(F.col("n"), s, empty=0).alias(f"by{s}") for s in (50, 7, 1000)])


@query("segment_slots", f"""WITH {SEG_SQL}, q AS (SELECT *, (128 + n - 1) // n AS quota FROM s)
SELECT doc_id, seg_idx, len(w[seg_idx * {SEGMENT} + 1:seg_idx * {SEGMENT} + {SEGMENT}])::BIGINT AS seg_len,
greatest(least(quota, 128 - seg_idx * quota), 0)::BIGINT AS n_slots,
CASE WHEN seg_idx * quota < 128 THEN 50000 + seg_idx * quota END::BIGINT AS first_slot FROM q""")
def segment_slots(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return G.segment_slots(words, "w", SEGMENT, 50000, 128).select(
        "doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("seg_len").cast("long").alias("seg_len"),
        F.size("slots").cast("long").alias("n_slots"), F.get("slots", F.lit(0)).cast("long").alias("first_slot"))


@query("valid_tokens", f"""WITH t AS (SELECT doc_id, list_filter({sql_tokens('text')}, lambda w: len(w) > 3) AS w FROM documents)
SELECT doc_id, greatest(len(w), 1)::BIGINT AS n_memory, (len(w) > 0)::INT::BIGINT AS mask, md5(coalesce(array_to_string(w, ' '), '')) AS digest FROM t""")
def valid_tokens(spark, sf):
    """Tokens of up to three letters are masked out; a text without any other keeps one memory with mask 0."""
    words = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    mask = F.transform("w", lambda w: (F.length(w) > 3).cast("int"))
    valid = words.select("doc_id", G.valid_tokens(F.col("w"), mask).alias("w"))
    return valid.select("doc_id", F.greatest(F.size("w"), F.lit(1)).cast("long").alias("n_memory"),
                        (F.size("w") > 0).cast("long").alias("mask"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("tail_slots", f"""WITH t AS (SELECT doc_id, {sql_ids(sql_tokens('text'))} AS a, CASE WHEN doc_id % 2 = 0 THEN 128 ELSE 64 END AS m FROM documents)
SELECT doc_id, m::BIGINT AS n_slots, (len(a) + m)::BIGINT AS length, {sql_digest('list_concat(a, list_transform(range(m), lambda x: 60000 + x))')} AS digest,
(60000 + m - 1)::BIGINT AS last_id FROM t""")
def tail_slots(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", ids(tokens(F.col("text"))).alias("a"))
    by_merge = {m: G.tail_slots(F.col("a"), 60000, n) for m, n in G.TAIL_SLOTS.items()}
    even = F.col("doc_id") % 2 == 0
    slots = F.when(even, F.lit(G.TAIL_SLOTS[4])).otherwise(F.lit(G.TAIL_SLOTS[8]))
    joined = rows.select("doc_id", slots.alias("m"), F.when(even, by_merge[4]).otherwise(by_merge[8]).alias("a"))
    tail = F.slice("a", -F.col("m"), F.col("m"))
    return joined.select("doc_id", F.size(tail).cast("long").alias("n_slots"), F.size("a").cast("long").alias("length"),
                         digest(F.col("a")).alias("digest"), F.element_at(tail, -1).cast("long").alias("last_id"))
