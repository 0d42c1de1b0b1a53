"""Prompt templates of common chat models: system prompt, form of one question, separator between turns."""

from __future__ import annotations


def tag(name: str, bar: str = "|") -> str:
    return "<" + bar + name + bar + ">"


Q = "{query}"
IM_END = tag("im_end") + "\n"


def im(role: str) -> str:
    return tag("im_start") + role + "\n"


CHATML = im("user") + Q + IM_END + im("assistant")
SYSTEM = im("system") + "You are a helpful assistant." + tag("im_end") + "\n"


def named(user: str, bot: str, gap: str = "\n") -> str:
    """Questions and answers behind names."""
    return user + Q + gap + bot


def headed(role: str) -> str:
    return tag("start_header_id") + role + tag("end_header_id") + "\n\n"


CURIOUS = "A chat between a curious user and an assistant."
INST = "[INST] " + Q + " [/INST]"

#: name: (system prompt, prompt of one question, separator)
TEMPLATES: dict[str, tuple[str, str, str]] = {
    "base": ("", Q, "</s>"),
    "vicuna": (CURIOUS, named("USER: ", "ASSISTANT:", " "), "</s>"),
    "alpaca": ("Below is an instruction that describes a task. Write a response that completes it.", named("### Instruction:\n", "### Response:\n", "\n\n"), "\n\n"),
    "baichuan": ("", "<reserved_102>" + Q + "<reserved_103>", "</s>"),
    "baichuan2": ("", "<reserved_106>" + Q + "<reserved_107>", "</s>"),
    "ziya": ("", named("<human>:", "<bot>:"), "\n"),
    "linly": ("", named("User: ", "Bot: "), "\n"),
    "chatglm": ("", named("问：", "答："), "\n"),
    "chatglm2": ("", named("问：", "答：", "\n\n"), "\n\n"),
    "chatglm3": ("", tag("user") + "\n" + Q + tag("assistant"), "\n"),
    "phoenix": (CURIOUS, "Human: <s>" + Q + "</s>Assistant: ", "</s>"),
    "belle": ("", named("Human: ", "Belle: ", "\n\n"), "\n\n"),
    "aquila": (CURIOUS, "Human: " + Q + "###Assistant:", "###"),
    "intern": ("", tag("User") + ":" + Q + "<eoh>\n" + tag("Bot") + ":", "<eoa>\n"),
    "intern2": (SYSTEM, CHATML, IM_END),
    "starchat": ("<system>\n", tag("user") + "\n" + Q + tag("end") + "\n" + tag("assistant") + "\n", tag("end") + "\n"),
    "llama2": ("<<SYS>>\nYou are an honest and helpful assistant.\n<</SYS>>\n\n", INST, "</s>"),
    "llama2-zh": ("<<SYS>>\n你是一个乐于助人的助手。\n<</SYS>>\n\n", INST, "</s>"),
    "llama3": (headed("system") + "You are a helpful assistant.", headed("user") + Q + tag("eot_id") + headed("assistant"), tag("eot_id")),
    "mistral": ("", INST, "</s>"),
    "xverse": ("", named("Human: ", "Assistant: ", "\n\n"), "</s>"),
    "chatml": ("You are a helpful assistant.", CHATML, IM_END),
    "deepseek": ("", named("User: ", "Assistant:", "\n\n"), "</s>"),
    "deepseek3": ("", tag("User", "｜") + Q + tag("Assistant", "｜"), "</s>"),
    "deepseekcoder": ("You are an AI programming assistant.", named("### Instruction:\n", "### Response:\n"), "\n"),
    "yi": ("", CHATML, "\n"),
    "orion": ("", named("Human: ", "Assistant: </s>", "\n\n"), "</s>"),
    "cohere": ("<BOS_TOKEN>", tag("START_OF_TURN_TOKEN") + tag("USER_TOKEN") + Q + tag("END_OF_TURN_TOKEN") + tag("START_OF_TURN_TOKEN") + tag("CHATBOT_TOKEN"), "</s>"),
    "qwen": (SYSTEM, CHATML, "\n"),
    "qwen3": (SYSTEM, CHATML, "\n"),
    "qwen3_nothink": (SYSTEM, CHATML + "<think>\n\n</think>\n\n", "\n"),
    "qwen3_5": (SYSTEM, CHATML, "\n"),
    "qwen3_5_nothink": (SYSTEM, CHATML + "<think>\n\n</think>\n\n", "\n"),
}


def register_template(name: str, system: str, prompt: str, sep: str) -> None:
    TEMPLATES[name] = (system, prompt, sep)
