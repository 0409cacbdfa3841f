"""Prompt and answer-frame text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folio import constants as K


def _turn(role: str, text: Column) -> Column:
    return F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>"))


def training_chat(question: Column, answer: Column) -> Column:
    """System, user and assistant turn of one training row."""
    return F.concat_ws(
        "\n",
        _turn("system", F.lit(K.SYSTEM_TURN + "\n")),
        _turn("user", question),
        _turn("assistant", answer),
    )


def chat_prompt(messages: Column) -> Column:
    """Text of ``array<struct<role,text>>`` plus the opening of the assistant's turn."""
    turns = F.transform(
        messages,
        lambda m: F.concat(F.lit("<|im_start|>"), m.role, F.lit("\n"), m.text, F.lit("<|im_end|>\n")),
    )
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n"))


def context_line(kind: Column, a: Column, b: Column, dosage: Column, function: Column) -> Column:
    fields = [F.coalesce(x.cast("string"), F.lit("")) for x in (kind, a, b, dosage, function)]
    return F.concat(F.lit("'"), F.concat_ws("  ", *fields), F.lit("' \n"))


def answer_prompt(question: Column, context: Column) -> Column:
    """Prompt of a request. The context part is left out when there is no context."""
    plain = F.concat(F.lit("Question: "), question, F.lit(K.ANSWER_REQUEST))
    with_context = F.concat(F.lit("Context: "), context, F.lit("\n"), plain)
    return F.when(F.length(context) > 0, with_context).otherwise(plain)


def name_question(ingredients: Column) -> Column:
    return F.concat(F.lit(K.INGREDIENTS_MARK), ingredients, F.lit(K.NAME_QUESTION_SUFFIX))


def paraphrase_prompt(text: Column) -> Column:
    return F.concat(F.lit(K.PARAPHRASE_PROMPT), text)


def sse_frame(text: Column) -> Column:
    return F.concat(F.lit("data: "), text, F.lit("\n\n"))


def full_model_name(name: Column, owner: str = "Qwen") -> Column:
    return F.when(F.contains(name, F.lit("/")), name).otherwise(F.concat(F.lit(owner + "/"), name))
