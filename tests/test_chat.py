"""Templates, rendering and labels."""

import pytest
from pyspark.sql import functions as F

from foldline.functions.text import stable_hash
from foldline.operators import conversations as C
from foldline.plans.templates import REGISTRY, TEMPLATES, Template, TemplateRegistry


def talk(spark, template, texts, system=None):
    rows = [(1, i, ("user", "assistant")[i % 2], t, template) for i, t in enumerate(texts)]
    messages = spark.createDataFrame(rows, "conv_id long, pos long, role string, text string, template string")
    heads = spark.createDataFrame([(1, system, template)], "conv_id long, system string, template string")
    return messages, heads, REGISTRY.frame(spark, [template])


@pytest.mark.parametrize("template, texts, system, expected", [
    ("llama-2", ["Hi", "Yo", "So"], None, "[INST] Hi [/INST] Yo </s><s>[INST] So "),
    ("gemma", ["Hi", None], None, "<bos><start_of_turn>user\nHi<end_of_turn>\n<start_of_turn>model\n"),
    ("llama-2", ["Hi", None], "Be kind.", "[INST] <<SYS>>\nBe kind.\n<</SYS>>\n\nHi [/INST]"),
    ("vicuna_v1.1", ["Hi", "Yo", None], "S.", "S. USER: Hi ASSISTANT: Yo</s>USER:"),
    ("chatglm2", ["q", "a", "r"], None, "[Round 1]\n\n问：q\n\n答：a\n\n[Round 2]\n\n问：r\n\n"),
    ("yuan2", ["on", "then"], None, "on<n>the<sep>"),
    ("cllm", ["1", "2", "3"], "S", "S ASSISTANT: 2 USER: 3</s>"),
    ("metamath", ["q", None], "S", "S\n\n### Instruction:\nq\n\n### Response: Let's think step by step."),
    ("mistral", ["", "b"], None, "[INST] [INST][/INST] b</s>"),
])
def test_rendering(spark, template, texts, system, expected):
    assert C.render(*talk(spark, template, texts, system), [REGISTRY.get(template).style]).first().prompt == expected


def test_example_turns_come_first(spark):
    prompt = C.render(*talk(spark, "baize", ["Q"]), ["NO_COLON_SINGLE"]).first().prompt
    assert prompt.endswith("exactly that format.\n[|Human|]Hello!\n[|AI|]Hi!\n[|Human|]Q\n")


def test_a_template_without_style_cannot_be_rendered(spark):
    with pytest.raises(Exception, match="no separator style"):
        C.render(*talk(spark, "yandexgpt", ["Q"])).collect()


def test_registry():
    assert len(TEMPLATES) == 94
    registry = TemplateRegistry()
    with pytest.raises(ValueError):
        registry.register(Template("raw"))
    registry.register(Template("raw", system="x"), override=True)
    assert registry.get("raw").system == "x" and registry.get("raw", system="y").system == "y"
    assert registry.get("raw").system == "x"
    with pytest.raises(KeyError):
        registry.get("nobody")


def test_two_turns_of_one_role_are_found(spark):
    messages, heads, templates = talk(spark, "llama-2", ["a", "b", "c"])
    folded = messages.withColumn("role", F.lit("user"))
    assert C.alternation_violations(folded).count() == 2
    with pytest.raises(Exception, match="two turns in a row"):
        C.apply_chat_template(folded, heads, templates).collect()
    assert C.checked(folded, C.alternation_violations(folded), "quarantine").count() == 0


def test_generation_prompt_only_after_the_user(spark):
    messages, _, _ = talk(spark, "llama-2", ["a", "b"])
    assert C.generation_prompt(messages).count() == 2
    with pytest.raises(Exception, match="only follow a user turn"):
        C.generation_prompt(messages, strict=True).collect()


def test_labels_keep_the_assistant(spark):
    messages, heads, templates = talk(spark, "mistral", ["Hi you", "Yo man", "So", "ok"])
    labels = C.token_labels(C.render(messages, heads, templates, ["LLAMA2"]), stable_hash).orderBy("pos").collect()
    kept = [r.token for r in labels if r.label != -100]
    # '<s> [INST] Hi you [/INST] Yo man</s>[INST] So [/INST] ok</s>': the first turn has 7 tokens with its start mark,
    # the separator counts as one more, so the second turn is taken to start at token 8
    assert kept == ["Yo", "man</s>[INST]", "So"]


def test_image_rows_and_pairs(spark):
    messages, _, _ = talk(spark, "llama-2", ["a", "b", "c"])
    pairs = C.turn_pairs(messages).orderBy("pair").collect()
    assert [(r.user, r.assistant) for r in pairs] == [("a", "b"), ("c", None)]
    pictured = messages.withColumn("images", F.array(F.concat(F.lit("i"), "pos"), F.lit("z")))
    assert [r.image for r in C.image_refs(pictured).orderBy("pos", "place").collect()] == ["i0", "z", "i2", "z"]


def test_a_turn_with_images_alone_is_shown(spark):
    messages, heads, templates = talk(spark, "llava-chatml", [""])
    pictured = messages.withColumn("images", F.array(F.lit("a"), F.lit("b")))
    prompt = C.render(pictured, heads, templates, ["CHATML"]).first().prompt
    assert prompt.endswith("<|im_start|>user\n$$<image>$$$$<image>$$<|im_end|>\n")


def test_the_end_of_a_prompt_is_its_last_character(spark):
    messages, heads, templates = talk(spark, "yuan2", [None], "Be human")
    assert C.render(messages, heads, templates, ["YUAN2"]).first().prompt == "Be human\n<sep>"


def test_another_role_is_an_error(spark):
    messages, heads, templates = talk(spark, "vicuna_v1.1", ["a"])
    with pytest.raises(Exception, match="no such role: tool"):
        C.render(messages.withColumn("role", F.lit("tool")), heads, templates, ["ADD_COLON_TWO"]).collect()


def test_templates_without_labels(spark):
    messages, heads, templates = talk(spark, "vicuna_v1.1", ["a"])
    with pytest.raises(Exception, match="no chat template for labels: vicuna_v1.1"):
        C.apply_chat_template(messages, heads, templates).collect()
    plain, heads, _ = [x.withColumn("template", F.lit("no")) for x in talk(spark, "llama-2", ["a b", "c d"])]
    templates = REGISTRY.frame(spark, ["llama-2"])
    assert [r.prompt for r in C.apply_chat_template(plain, heads, templates).collect()] == ["a b c d</s>"]
    kept = [r.token for r in C.plain_labels(C.plain_template(plain), stable_hash).orderBy("pos").collect() if r.label != -100]
    assert kept == ["c", "d</s>"]
    folded = plain.withColumn("role", F.lit("assistant"))
    assert C.plain_template(folded).first().error == "two turns in a row have one role"
    longer, heads, _ = [x.withColumn("template", F.lit("no")) for x in talk(spark, "llama-2", ["a", "b", "c"])]
    with pytest.raises(Exception, match="needs a chat template"):
        C.apply_chat_template(longer, heads, templates).collect()


def test_one_conversation_with_most_turns(spark):
    texts = [f"t{i}" for i in range(3000)]
    messages, heads, templates = talk(spark, "llama-2", texts)
    prompt = C.apply_chat_template(messages, heads, templates).first().prompt
    assert prompt.startswith("[INST] t0 [/INST] t1 </s><s>[INST] t2") and prompt.endswith("[/INST] t2999 </s><s>")
    assert C.token_labels(C.apply_chat_template(messages, heads, templates), stable_hash).count() > 3000
