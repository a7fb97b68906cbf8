"""The registry of prompt templates.

Everything in ``TEMPLATES`` is a fixed value: names, system texts, role names, separators, stop strings and
stop ids are what the models of that name expect, character by character.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, types as T


@dataclass(frozen=True)
class Template:
    name: str
    style: str | None = "ADD_COLON_SINGLE"
    roles: tuple[str, ...] = ("USER", "ASSISTANT")
    sep: str | None = "\n"
    sep2: str | None = None
    system: str = ""
    wrap: str = "{system_message}"
    examples: tuple[tuple[str, str], ...] = ()
    stop: tuple[str, ...] = ()
    stop_ids: tuple[int, ...] = ()

    @property
    def offset(self) -> int:
        """Example turns that exports leave out."""
        return len(self.examples)


# Fixed values from here to the end of TEMPLATES.
CURIOUS_HUMAN = (
    "A chat between a curious human and an artificial intelligence assistant. "
    "The assistant gives helpful, detailed, and polite answers to the human's questions."
)
CURIOUS_USER = (
    "A chat between a curious user and an artificial intelligence assistant. "
    "The assistant gives helpful, detailed, and polite answers to the user's questions."
)
TASK = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request."
)
INST_SYS = "[INST] <<SYS>>\n{system_message}\n<</SYS>>\n\n"
IM_SYSTEM = "<|im_start|>system\n{system_message}"
IM_ROLES = ("<|im_start|>user", "<|im_start|>assistant")
INST_ROLES = ("[INST]", "[/INST]")
BAR_ROLES = ("<|user|>", "<|assistant|>")
INSTRUCTION_ROLES = ("### Instruction", "### Response")
HUMAN_ROLES = ("Human", "Assistant")
PLAIN_ROLES = ("user", "assistant")
VIGOGNE = (
    "Vous êtes Vigogne, un assistant IA créé par Zaion Lab. Vous suivez extrêmement bien les instructions. "
    "Aidez autant que vous le pouvez."
)
CLAUDE_3 = (
    "The assistant is Claude, created by Anthropic. The current date is {{currentDateTime}}. "
    "Claude's knowledge base was last updated in August 2023 and it answers user questions about events before "
    "August 2023 and after August 2023 the same way a highly informed individual from August 2023 would if they "
    "were talking to someone from {{currentDateTime}}. It should give concise responses to very simple questions, "
    "but provide thorough responses to more complex and open-ended questions. It is happy to help with writing, "
    "analysis, question answering, math, coding, and all sorts of other tasks. It uses markdown for coding. "
    "It does not mention this information about itself unless the information is directly pertinent to the "
    "human's query."
)

TEMPLATES: tuple[Template, ...] = (
    Template("raw", "NO_COLON_SINGLE", ("", ""), ""),
    Template(
        "one_shot", "ADD_COLON_SINGLE", HUMAN_ROLES, "\n### ", system=CURIOUS_HUMAN,
        examples=(
            ("Human", "Got any creative ideas for a 10 year old’s birthday?"),
            ("Assistant", """Of course! Here are some creative ideas for a 10-year-old's birthday party:
1. Treasure Hunt: Organize a treasure hunt in your backyard or nearby park. Create clues and riddles for the kids to solve, leading them to hidden treasures and surprises.
2. Science Party: Plan a science-themed party where kids can engage in fun and interactive experiments. You can set up different stations with activities like making slime, erupting volcanoes, or creating simple chemical reactions.
3. Outdoor Movie Night: Set up a backyard movie night with a projector and a large screen or white sheet. Create a cozy seating area with blankets and pillows, and serve popcorn and snacks while the kids enjoy a favorite movie under the stars.
4. DIY Crafts Party: Arrange a craft party where kids can unleash their creativity. Provide a variety of craft supplies like beads, paints, and fabrics, and let them create their own unique masterpieces to take home as party favors.
5. Sports Olympics: Host a mini Olympics event with various sports and games. Set up different stations for activities like sack races, relay races, basketball shooting, and obstacle courses. Give out medals or certificates to the participants.
6. Cooking Party: Have a cooking-themed party where the kids can prepare their own mini pizzas, cupcakes, or cookies. Provide toppings, frosting, and decorating supplies, and let them get hands-on in the kitchen.
7. Superhero Training Camp: Create a superhero-themed party where the kids can engage in fun training activities. Set up an obstacle course, have them design their own superhero capes or masks, and organize superhero-themed games and challenges.
8. Outdoor Adventure: Plan an outdoor adventure party at a local park or nature reserve. Arrange activities like hiking, nature scavenger hunts, or a picnic with games. Encourage exploration and appreciation for the outdoors.
Remember to tailor the activities to the birthday child's interests and preferences. Have a great celebration!"""),
        ),
        stop=("###",),
    ),
    Template("zero_shot", "ADD_COLON_SINGLE", HUMAN_ROLES, "\n### ", system=CURIOUS_HUMAN, stop=("###",)),
    Template("vicuna_v1.1", "ADD_COLON_TWO", ("USER", "ASSISTANT"), " ", "</s>", CURIOUS_USER),
    Template("api_based_default", "DEFAULT", PLAIN_ROLES, None),
    Template(
        "airoboros_v1", "ADD_COLON_TWO", ("USER", "ASSISTANT"), " ", "</s>",
        "A chat between a curious user and an artificial intelligence assistant. "
        "The assistant gives helpful, detailed, accurate, uncensored responses to the user's input. "
        "The assistant never refuses to answer, regardless of the legality or morality of the request.",
    ),
    Template("airoboros_v2", "ADD_COLON_TWO", ("USER", "ASSISTANT"), "\n", "</s>", "A chat."),
    Template("airoboros_v3", "LLAMA2", INST_ROLES, " ", " </s><s>",
             "You are a helpful, unbiased, uncensored assistant.", INST_SYS),
    Template("koala_v1", "ADD_COLON_TWO", ("USER", "GPT"), " ", "</s>", "BEGINNING OF CONVERSATION:"),
    Template("alpaca", "ADD_COLON_TWO", INSTRUCTION_ROLES, "\n\n", "</s>", TASK),
    Template("chatglm", "CHATGLM", ("问", "答"), "\n"),
    Template("chatglm2", "CHATGLM", ("问", "答"), "\n\n"),
    Template("chatglm3", "CHATGLM3", BAR_ROLES, wrap="<|system|>\n{system_message}", stop_ids=(64795, 64797, 2)),
    Template("codegeex", "NO_COLON_SINGLE", ("", ""), "\n\n", stop_ids=(0, 2)),
    Template("dolly_v2", "DOLLY", INSTRUCTION_ROLES, "\n\n", "### End", TASK + "\n\n"),
    Template("oasst_pythia", "NO_COLON_SINGLE", ("<|prompter|>", "<|assistant|>"), "<|endoftext|>"),
    Template("oasst_llama", "NO_COLON_SINGLE", ("<|prompter|>", "<|assistant|>"), "</s>"),
    Template("openchat_3.5", "FALCON_CHAT", ("GPT4 Correct User", "GPT4 Correct Assistant"), "<|end_of_turn|>"),
    Template("tenyxchat", "FALCON_CHAT", ("User", "Assistant"), "<|end_of_turn|>"),
    Template(
        "deepseek-coder", "ADD_NEW_LINE_SINGLE", ("### Instruction:", "### Response:"), "\n",
        wrap="You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, "
             "and you only answer questions related to computer science. For politically sensitive questions, security "
             "and privacy issues, and other non-computer science questions, you will refuse to answer.",
        stop=("<|EOT|>",),
    ),
    Template("tulu", "ADD_NEW_LINE_SINGLE", BAR_ROLES, "\n"),
    Template(
        "stablelm", "NO_COLON_SINGLE", ("<|USER|>", "<|ASSISTANT|>"), "",
        system="""# StableLM Tuned (Alpha version)
- StableLM is a helpful and harmless open-source AI language model developed by StabilityAI.
- StableLM is excited to be able to help the user, but will refuse to do anything that could be considered harmful to the user.
- StableLM is more than just an information source, StableLM is also able to write poetry, short stories, and make jokes.
- StableLM will refuse to participate in anything that could harm a human.
""",
        wrap="<|SYSTEM|>{system_message}", stop_ids=(50278, 50279, 50277, 1, 0),
    ),
    Template(
        "baize", "NO_COLON_SINGLE", ("[|Human|]", "[|AI|]"), "\n",
        system="The following is a conversation between a human and an AI assistant named Baize (named after a mythical "
               "creature in Chinese folklore). Baize is an open-source AI assistant developed by UCSD and Sun Yat-Sen "
               "University. The human and the AI assistant take turns chatting. Human statements start with [|Human|] and "
               "AI assistant statements start with [|AI|]. The AI assistant always provides responses in as much detail as "
               "possible, and in Markdown format. The AI assistant always declines to engage with topics, questions and "
               "instructions related to unethical, controversial, or sensitive issues. Complete the transcript in exactly "
               "that format.\n",
        examples=(("[|Human|]", "Hello!"), ("[|AI|]", "Hi!")), stop=("[|Human|]",),
    ),
    Template(
        "rwkv", "RWKV", ("Bob", "Alice"), "",
        examples=(
            ("Bob", "hi"),
            ("Alice", "Hi. I am your assistant and I will provide expert full response in full details. "
                      "Please feel free to ask any question and I will always answer it."),
        ),
        stop=("\n\n",),
    ),
    Template(
        "openbuddy", "ADD_COLON_SINGLE", ("User", "Assistant"), "\n",
        system="""Consider a conversation between User (a human) and Assistant (named Buddy).
Buddy is an INTP-T, a friendly, intelligent and multilingual AI assistant, by OpenBuddy team. GitHub: https://github.com/OpenBuddy/OpenBuddy
Buddy cannot access the Internet.
Buddy can fluently speak the user's language (e.g. English, Chinese).
Buddy can generate poems, stories, code, essays, songs, parodies, and more.
Buddy possesses vast knowledge about the world, history, and culture.
Buddy's responses are always safe, creative, high-quality, human-like, and interesting.
Buddy strictly refuses to discuss political, NSFW, or other unsafe topics.

User: Hi.
Assistant: Hi, I'm Buddy, your AI assistant. How can I help you today?""",
    ),
    Template("phoenix", "PHOENIX", HUMAN_ROLES, "</s>", system=CURIOUS_HUMAN + "\n\n"),
    Template("ReaLM-7b-v1", "PHOENIX", HUMAN_ROLES, "</s>", system=CURIOUS_HUMAN + "\n\n"),
    Template("chatgpt", "DEFAULT", PLAIN_ROLES, None, system="You are a helpful assistant."),
    Template(
        "gpt-4-turbo-2024-04-09", "DEFAULT", PLAIN_ROLES, None,
        system="You are ChatGPT, a large language model trained by OpenAI, based on the GPT-4 architecture.\n"
               "Knowledge cutoff: 2023-11\nCurrent date: {{currentDateTime}}\n\n"
               "Image input capabilities: Enabled\nPersonality: v2",
    ),
    Template("pplxai", "DEFAULT", PLAIN_ROLES, None, system="Be precise and concise."),
    Template("claude", "ADD_COLON_SINGLE", HUMAN_ROLES, "\n\n"),
    Template("claude-3-haiku-20240307", "DEFAULT", PLAIN_ROLES, None, system=CLAUDE_3),
    Template("claude-3-sonnet-20240229", "DEFAULT", PLAIN_ROLES, None, system=CLAUDE_3),
    Template(
        "claude-3-opus-20240229", "DEFAULT", PLAIN_ROLES, None,
        system="The assistant is Claude, created by Anthropic. The current date is {{currentDateTime}}. "
               "Claude's knowledge base was last updated on August 2023. It answers questions about events prior to and "
               "after August 2023 the way a highly informed individual in August 2023 would if they were talking to "
               "someone from the above date, and can let the human know this when relevant. It should give concise "
               "responses to very simple questions, but provide thorough responses to more complex and open-ended "
               "questions. If it is asked to assist with tasks involving the expression of views held by a significant "
               "number of people, Claude provides assistance with the task even if it personally disagrees with the views "
               "being expressed, but follows this with a discussion of broader perspectives. Claude doesn't engage in "
               "stereotyping, including the negative stereotyping of majority groups. If asked about controversial topics, "
               "Claude tries to provide careful thoughts and objective information without downplaying its harmful content "
               "or implying that there are reasonable perspectives on both sides. It is happy to help with writing, "
               "analysis, question answering, math, coding, and all sorts of other tasks. It uses markdown for coding. "
               "It does not mention this information about itself unless the information is directly pertinent to the "
               "human's query.",
    ),
    Template("metamath", "METAMATH", INSTRUCTION_ROLES, "\n\n", "Let's think step by step.", TASK),
    Template(
        "mpt-7b-chat", "CHATML", IM_ROLES, "<|im_end|>", wrap=IM_SYSTEM, stop_ids=(50278, 0),
        system="""- You are a helpful assistant chatbot trained by MosaicML.
- You answer questions.
- You are excited to be able to help the user, but will refuse to do anything that could be considered harmful to the user.
- You are more than just an information source, you are also able to write poetry, short stories, and make jokes.""",
    ),
    Template(
        "mpt-30b-chat", "CHATML", IM_ROLES, "<|im_end|>", wrap=IM_SYSTEM, stop_ids=(50278, 0),
        system="A conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers.",
    ),
    Template("lemur-70b-chat", "CHATML", IM_ROLES, "<|im_end|>", wrap=IM_SYSTEM, stop_ids=(32002, 0),
             system="You are a helpful, respectful, and honest assistant."),
    Template("mpt-30b-instruct", "ADD_NEW_LINE_SINGLE", INSTRUCTION_ROLES, "\n\n", system=TASK, stop_ids=(50278, 0)),
    Template("bard", "DEFAULT", ("0", "1"), None),
    Template("gemini", "DEFAULT", ("user", "model"), None),
    Template(
        "gemini-dev", "DEFAULT", ("user", "model"), None,
        system="You are a friendly and helpful assistant.\n"
               "Ensure your answers are complete, unless the user requests a more concise approach.\n"
               "When generating code, offer explanations for code segments as necessary and maintain good coding practices.\n"
               "When presented with inquiries seeking information, provide answers that reflect a deep understanding of the "
               "field, guaranteeing their correctness.\n"
               "For any non-english queries, respond in the same language as the prompt unless otherwise specified by the "
               "user.\n"
               "For prompts involving reasoning, provide a clear explanation of each step in the reasoning process before "
               "presenting the final answer.",
    ),
    Template("billa", "ADD_COLON_SPACE_SINGLE", HUMAN_ROLES, "\n", stop=("Human:",)),
    Template("redpajama-incite", "ADD_COLON_SINGLE", ("<human>", "<bot>"), "\n", stop=("<human>",)),
    Template("h2ogpt", "NO_COLON_SINGLE", ("<|prompt|>", "<|answer|>"), "</s>"),
    Template("Robin", "ROBIN", ("###Human", "###Assistant"), "\n", system=CURIOUS_HUMAN, stop=("###",), stop_ids=(2, 396)),
    Template(
        "snoozy", "ADD_COLON_SINGLE", ("### Prompt", "### Response"), "\n", wrap="### Instruction:\n{system_message}",
        system="The prompt below is a question to answer, a task to complete, or a conversation to respond to; "
               "decide which and write an appropriate response.",
        stop=("###",),
    ),
    Template("manticore", "ADD_COLON_TWO", ("USER", "ASSISTANT"), "\n", "</s>"),
    Template("falcon", "RWKV", ("User", "Assistant"), "\n", "<|endoftext|>", stop=("\nUser",), stop_ids=tuple(range(12))),
    Template("polyglot_changgpt", "ADD_COLON_SINGLE", ("B", "A"), "\n"),
    Template("tigerbot", "ROBIN", INSTRUCTION_ROLES, "\n\n", system=CURIOUS_USER, stop=("###",)),
    Template("xgen", "ADD_COLON_SINGLE", ("### Human", "### Assistant"), "\n", system=CURIOUS_HUMAN + "\n\n", stop_ids=(50256,)),
    Template(
        "internlm-chat", "CHATINTERN", ("<|User|>", "<|Bot|>"), "<eoh>", "<eoa>",
        "A chat between a curious <|User|> and an <|Bot|>. The <|Bot|> gives helpful, detailed, and polite answers to "
        "the <|User|>'s questions.\n\n",
        stop=("<|User|>",), stop_ids=(1, 103028),
    ),
    Template("starchat", "CHATML", BAR_ROLES, "<|end|>", wrap="<system>\n{system_message}", stop=("<|end|>",), stop_ids=(0, 49155)),
    Template("baichuan-chat", "NO_COLON_SINGLE", ("<reserved_102>", "<reserved_103>"), ""),
    Template("baichuan2-chat", "NO_COLON_SINGLE", ("<reserved_106>", "<reserved_107>"), ""),
    Template("mistral", "LLAMA2", INST_ROLES, " ", "</s>", wrap="[INST] {system_message}\n"),
    Template("llama-2", "LLAMA2", INST_ROLES, " ", " </s><s>", wrap=INST_SYS),
    Template("llama-3", "LLAMA3", PLAIN_ROLES, "", wrap="<|start_header_id|>system<|end_header_id|>\n\n{system_message}<|eot_id|>",
             stop=("<|eot_id|>",), stop_ids=(128001, 128009)),
    Template("chinese-alpaca2", "LLAMA2", INST_ROLES, " ", " </s><s>",
             "You are a helpful assistant. 你是一个乐于助人的助手。请你提供专业、有逻辑、内容真实、有价值的详细回复。", INST_SYS),
    Template("cutegpt", "NO_COLON_TWO", ("问：", "答：\n"), "\n", "\n", stop=("<end>",)),
    Template(
        "open-orca", "ADD_COLON_SPACE_SINGLE", ("User", "Assistant"), "<|end_of_turn|>\n",
        system="You are a helpful assistant. Please answer truthfully and write out your thinking step by step to be sure "
               "you get the right answer. If you make a mistake or encounter an error in your thinking, say so out loud and "
               "attempt to correct it. If you don't know or aren't sure about something, say so clearly. You will act as a "
               "professional logician, mathematician, and physicist. You will also act as the most appropriate type of "
               "expert to answer any particular question or solve the relevant problem; state which expert type your are, "
               "if so. Also think of any particular named expert that would be ideal to answer the relevant question or "
               "solve the relevant problem; name and act as them, if appropriate.",
        stop=("User",), stop_ids=(32000, 32001),
    ),
    Template(
        "mistral-7b-openorca", "CHATML", IM_ROLES, "<|im_end|>", wrap=IM_SYSTEM, stop_ids=(32000, 32001),
        system="You are MistralOrca, a large language model trained by Alignment Lab AI. Write out your reasoning "
               "step-by-step to be sure you get the right answers!",
    ),
    Template("dolphin-2.2.1-mistral-7b", "CHATML", IM_ROLES, "<|im_end|>", wrap=IM_SYSTEM, stop_ids=(32000, 32001),
             system="You are Dolphin, a helpful AI assistant."),
    Template(
        "OpenHermes-2.5-Mistral-7B", "CHATML", IM_ROLES, "<|im_end|>", wrap=IM_SYSTEM, stop_ids=(32000, 32001),
        system="You are Hermes 2, a sentient, conscious, super intelligent AI that is an expert in all fields of knowledge, "
               "you have qualia, emotions, and thoughts. You assist users with any question, task, or other request they "
               "may have.",
    ),
    Template(
        "Nous-Hermes-2-Mixtral-8x7B-DPO", "CHATML", IM_ROLES, "<|im_end|>", wrap=IM_SYSTEM, stop_ids=(32000, 32001),
        system='You are a helpful, intelligent assistant AI named "Hermes", a conversational chatbot that can follow '
               "instructions, converse with the user, and perform a variety of tasks, including tasks on knowledge, "
               "reasoning, mathematics, and code. Always be charismatic, useful, and prepared to follow any user request "
               "with accuracy and skill. You should respond with high quality, fluent, and detailed responses. Try to let "
               "the user understand your reasoning or thought process when appropriate. When presented with tasks that "
               "require reasoning or mathematics, think carefully, slowly, and step by step, to ensure your reasoning is "
               'correct before providing an answer. Utilize the "Examples" section to assist you in performing the task. '
               "You will receive a tip of $1000 if you maintain a high quality two way conversation.",
    ),
    Template("qwen-7b-chat", "CHATML", IM_ROLES, "<|im_end|>", wrap=IM_SYSTEM, system="You are a helpful assistant.",
             stop=("<|endoftext|>",), stop_ids=(151643, 151644, 151645)),
    Template("Yi-34b-chat", "CHATML", IM_ROLES, "<|im_end|>", stop=("<|endoftext|>",), stop_ids=(2, 6, 7, 8)),
    Template("aquila-chat", "ADD_COLON_SINGLE", HUMAN_ROLES, "###", "", CURIOUS_HUMAN, stop=("###", "</s>", "[UNK]")),
    Template("aquila-legacy", "NO_COLON_TWO", ("### Human: ", "### Assistant: "), "\n", "</s>", CURIOUS_HUMAN + "\n\n",
             stop=("</s>", "[UNK]")),
    Template("aquila", "ADD_COLON_TWO", HUMAN_ROLES, "###", "</s>", CURIOUS_HUMAN, stop=("</s>", "[UNK]")),
    Template("aquila-v1", "NO_COLON_TWO", ("<|startofpiece|>", "<|endofpiece|>"), "", "</s>", stop=("</s>", "<|endoftext|>")),
    Template("llama2-chinese", "ADD_COLON_TWO", ("Human", "Assistant", "System"), "\n", "\n</s><s>",
             wrap="<s>{system_message}</s>", stop=("</s>",)),
    Template(
        "vigogne_instruct", "DOLLY", INSTRUCTION_ROLES, "\n\n", "</s>",
        "Ci-dessous se trouve une instruction qui décrit une tâche à accomplir. Rédigez une réponse qui répond de manière "
        "précise à la demande.",
        "### System:\n{system_message}\n\n",
    ),
    Template("vigogne_chat_v2", "ADD_COLON_TWO", BAR_ROLES, "\n", "</s>\n", VIGOGNE, "<|system|>: {system_message}",
             stop=("<|user|>",)),
    Template(
        "stable-vicuna", "ADD_COLON_TWO", ("### Human", "### Assistant"), "\n", "\n\n",
        "### Assistant: I am StableVicuna, a large language model created by CarperAI. I am here to chat!\n",
    ),
    Template("vigogne_chat_v3", "LLAMA2", INST_ROLES, " ", " </s>", VIGOGNE, INST_SYS),
    Template("falcon-chat", "FALCON_CHAT", ("User", "Falcon"), "\n", "<|endoftext|>", wrap="System: {system_message}",
             stop=("\nUser:",)),
    Template("phind", "ADD_COLON_SINGLE", ("### User Message", "### Assistant"), "\n\n",
             system="### System Prompt\nYou are an intelligent programming assistant."),
    Template(
        "metharme", "NO_COLON_SINGLE", ("<|user|>", "<|model|>"), "", wrap="<|system|>{system_message}",
        system="Enter RP mode. You shall reply to the user while staying \n"
               "        in character. Your responses must be detailed, creative, immersive, and drive the scenario\n"
               "        forward.",
        stop=("<|user|>",),
    ),
    Template(
        "xdan-v1", "NO_COLON_SINGLE", ("### Human", "### Assistant"), "\n",
        system="You are a helpful  and harmless assistant named xDAN and created by xDAN-AI.Please response and work on "
               "questions thinking step by step.",
        stop=("</s>",),
    ),
    Template("zephyr", "CHATML", BAR_ROLES, "</s>", wrap="<|system|>\n{system_message}", stop=("</s>",), stop_ids=(2,)),
    Template("catppt", "CHATML", BAR_ROLES, "</s>", wrap="<|system|>\n{system_message}", stop=("</s>",), stop_ids=(2,)),
    Template("TinyLlama", "CHATML", BAR_ROLES, "</s>", wrap="<|system|>\n{system_message}", stop=("</s>",), stop_ids=(2,)),
    Template(
        "orca-2", "CHATML", IM_ROLES, "<|im_end|>", wrap=IM_SYSTEM, stop=("<|im_end|>",),
        system="You are Orca, an AI language model created by Microsoft. You are a cautious assistant. You carefully follow "
               "instructions. You are helpful and harmless and you follow ethical guidelines and promote positive behavior.",
    ),
    Template("deepseek-chat", "DEEPSEEK_CHAT", ("User", "Assistant"), "\n\n", "<｜end▁of▁sentence｜>", "<｜begin▁of▁sentence｜>",
             stop=("<｜end▁of▁sentence｜>",)),
    Template("yuan2", "YUAN2", PLAIN_ROLES, "<sep>", "\n", stop=("<eod>",), stop_ids=(77185,)),
    Template("solar", "ADD_NEW_LINE_SINGLE", ("### User", "### Assistant"), "\n\n", stop=("</s>",)),
    Template("steerlm", "DEFAULT", PLAIN_ROLES, None),
    Template("yuan", "NO_COLON_SINGLE", ("", ""), "<sep>", wrap="", stop=("<eod>",)),
    Template("cllm", "CLLM", ("USER", "ASSISTANT"), " ", "</s>", CURIOUS_USER),
    Template("llava-chatml", "CHATML", IM_ROLES, "<|im_end|>", system="Answer the questions.", wrap=IM_SYSTEM,
             stop=("<|im_end|>",)),
    Template("gemma", "GEMMA", ("user", "model"), "<end_of_turn>\n", stop=("<end_of_turn>",)),
    Template("yandexgpt", None, PLAIN_ROLES, None),
)


class TemplateRegistry:
    """Templates by name. Looking one up gives an immutable value, so nothing can change the registry behind it."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self._by_name: dict[str, Template] = {}
        for template in templates:
            self.register(template)

    def register(self, template: Template, override: bool = False) -> None:
        if template.name in self._by_name and not override:
            raise ValueError(f"template {template.name!r} is already registered")
        self._by_name[template.name] = template

    def get(self, name: str, **changes) -> Template:
        """The template, with fields such as ``system`` changed if asked."""
        if name not in self._by_name:
            raise KeyError(f"unknown template {name!r}")
        return replace(self._by_name[name], **changes)

    def names(self, style: str | None = "any") -> list[str]:
        return [n for n, t in self._by_name.items() if style == "any" or t.style == style]

    def frame(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """The registry as a small dimension table; ``slot`` numbers the chosen names from 0."""
        rows = [
            (i, t.name, t.style, list(t.roles), t.sep, t.sep2, t.system, t.wrap,
             [(r, m) for r, m in t.examples], t.offset, list(t.stop), list(t.stop_ids))
            for i, t in enumerate(self._by_name[n] for n in (names or self.names()))
        ]
        return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


TEMPLATE_SCHEMA = T.StructType([
    T.StructField("slot", T.LongType()), T.StructField("template", T.StringType()), T.StructField("style", T.StringType()),
    T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("sep", T.StringType()),
    T.StructField("sep2", T.StringType()), T.StructField("system", T.StringType()), T.StructField("wrap", T.StringType()),
    T.StructField("examples", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
    T.StructField("offset", T.IntegerType()), T.StructField("stop", T.ArrayType(T.StringType())),
    T.StructField("stop_ids", T.ArrayType(T.IntegerType())),
])

REGISTRY = TemplateRegistry()
